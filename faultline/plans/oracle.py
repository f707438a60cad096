"""The registered queries as plain SQL over the same tables, for checking."""

from __future__ import annotations

import numpy as np

from faultline.models import grid
from faultline.operators import windows
from faultline.plans.queries import ENTROPY_M, EXACT, SEPARABLE, JOB, K, SKIPPED, SLIDE, TOLERANCE
from faultline.schema import FLOAT32_MAX, TEST_WELLS, VARIABLES

FEATURES = windows.feature_names()
SIZE, STEP = JOB.size, JOB.step

_AGGREGATES = {
    "max": "max({v})",
    "mean": "avg({v})",
    "median": "median({v})",
    "min": "min({v})",
    "std": "stddev_samp({v})",
    "var": "var_samp({v})",
}
_STATS = ", ".join(
    f"{a.format(v=v)} AS {v}_{s}" for v in VARIABLES for s, a in _AGGREGATES.items()
)
_F = ", ".join(FEATURES)
_V = ", ".join(VARIABLES)


def _rounded(columns: list[str] = FEATURES, prefix: str = "") -> str:
    return ", ".join(
        f"round({prefix}{c}, {4 if c.endswith(('_std', '_var')) else 7}) AS {c}" for c in columns
    )


# A deviation of 0 becomes 1.
_SCALING = ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
    for c in FEATURES
)
_LINE = "class_id, instance_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
_KEYS = "class_id, instance_id, w"

# Named steps, in order; a statement takes the ones it needs with `_with`.
_STEPS: dict[str, tuple[list[str], str]] = {
    "raw": (
        [],
        """SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 WHEN 'R' THEN 4 END
                  + CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS class_id,
                  l_suppkey AS instance_id, CAST(l_suppkey % 10 AS INTEGER) AS well_id,
                  l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
                  l_quantity AS v1, l_extendedprice / 1000 AS v2, nullif(l_discount, 0.0) AS v3,
                  l_tax AS v4, CAST(l_linenumber AS DOUBLE) AS v5
           FROM lineitem""",
    ),
    "clean": (
        ["raw"],
        "SELECT * FROM raw WHERE " + " AND ".join(f"{v} IS NOT NULL" for v in VARIABLES),
    ),
    "placed": (
        ["clean"],
        f"""SELECT *, row_number() OVER (PARTITION BY class_id, instance_id ORDER BY {_ORDER}) - 1
                   AS pos, count(*) OVER (PARTITION BY class_id, instance_id) AS n_rows
            FROM clean""",
    ),
    "feats": (
        ["placed"],
        f"""SELECT class_id, instance_id, well_id, pos // {SIZE} AS w, {_STATS}
            FROM placed
            WHERE pos // {SIZE} < greatest((n_rows - {SIZE}) // {STEP}, 1)
            GROUP BY ALL""",
    ),
    "lab_a": (
        ["feats"],
        """SELECT *, CASE WHEN class_id = 4 THEN 1 ELSE 0 END AS label
           FROM feats WHERE class_id IN (0, 4)""",
    ),
    "lab_b": (
        ["feats"],
        "SELECT *, CASE WHEN class_id = 4 THEN 1 ELSE 0 END AS label FROM feats",
    ),
    "lab_rows": (
        ["clean"],
        "SELECT *, CASE WHEN class_id = 4 THEN 1 ELSE 0 END AS label FROM clean",
    ),
    "lab_recs": (
        ["lab_rows"],
        """SELECT class_id, instance_id, label, count(*) AS n
           FROM lab_rows GROUP BY ALL""",
    ),
}


def _kfold(source: str, rounds: int = 1) -> str:
    return f"""SELECT s.*, CAST(r.round AS INTEGER) AS round,
        CAST(ntile({K}) OVER (PARTITION BY r.round, label
             ORDER BY md5(concat_ws('|', r.round, class_id, instance_id, w)), {_KEYS}) - 1
             AS INTEGER) AS fold
        FROM {source} s, (SELECT unnest(range(1, {rounds + 1})) AS round) r"""


def _wells(source: str, rounds: int = 1, wells: list[int] = TEST_WELLS) -> str:
    return f"""SELECT s.*, CAST(r.round AS INTEGER) AS round,
        CAST(list_position({wells}, well_id) - 1 AS INTEGER) AS fold
        FROM {source} s, (SELECT unnest(range(1, {rounds + 1})) AS round) r"""


def _expand(source: str, k: int = K) -> str:
    return f"""SELECT s.* EXCLUDE (fold), CAST(f.fold AS INTEGER) AS fold,
        CASE WHEN s.fold IS NOT DISTINCT FROM f.fold THEN 'valid' ELSE 'train' END AS split
        FROM {source} s, (SELECT unnest(range({k})) AS fold) f"""


_STEPS |= {
    "fold_a": (["lab_a"], _kfold("lab_a")),
    "fold_b": (["lab_b"], _kfold("lab_b")),
    "well_a": (["lab_a"], _wells("lab_a")),
    "well_b": (["lab_b"], _wells("lab_b")),
    "sides": (["fold_a"], _expand("fold_a")),
    "scaler": (
        ["sides"],
        """SELECT round, fold, feature, avg(x) AS mean,
                  CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS scale, count(*) AS n
           FROM (UNPIVOT (SELECT * FROM sides WHERE split = 'train') ON """
        + _F
        + """ INTO NAME feature VALUE x)
           GROUP BY ALL""",
    ),
    "scale_row": (
        ["scaler"],
        "SELECT round, fold, "
        + ", ".join(
            f"max(mean) FILTER (feature = '{c}') AS m_{c}, max(scale) FILTER (feature = '{c}') AS s_{c}"
            for c in FEATURES
        )
        + " FROM scaler GROUP BY ALL",
    ),
    "z": (
        ["sides", "scale_row"],
        f"SELECT round, fold, split, {_KEYS}, label, "
        + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES)
        + " FROM sides JOIN scale_row USING (round, fold)",
    ),
}


def _with(*names: str, extra: dict[str, str] | None = None) -> str:
    """The WITH clause of the named steps and all they stand on."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        needs, body = _STEPS[name]
        for n in needs:
            add(n)
        found.setdefault(name, body)

    for name in names:
        add(name)
    found |= extra or {}
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({b})" for n, b in found.items()) + "\n"


# ---- predictions ---------------------------------------------------------------------------------

_ZERO = """SELECT v.round, v.fold, v.class_id, v.instance_id, v.w, v.label AS y, b.p
    FROM {sides} v JOIN (
        SELECT round, fold, arg_max(label, n * 10 - label) AS p
        FROM (SELECT round, fold, label, count(*) AS n FROM {sides} WHERE split = 'train' GROUP BY ALL)
        GROUP BY ALL) b USING (round, fold)
    WHERE v.split {test}"""

_DISTANCE = "sqrt(" + " + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in FEATURES) + ")"


def _near(k: int, test: str = "= 'valid'", z: str = "z", by: str = "round, fold") -> str:
    """The k nearest training rows of every row to predict, ranked."""
    q_by = ", ".join(f"q.{c}" for c in by.split(", "))
    return f"""SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY {by}, {_KEYS} ORDER BY d, label, tc, ti, tw) AS nth
        FROM (SELECT {q_by}, q.class_id, q.instance_id, q.w, q.label AS y, t.label,
                     t.class_id AS tc, t.instance_id AS ti, t.w AS tw, {_DISTANCE} AS d
              FROM (SELECT * FROM {z} WHERE split {test}) q
              JOIN (SELECT * FROM {z} WHERE split = 'train') t USING ({by})))
        WHERE nth <= {k}"""


def _vote_distance(near: str = "near") -> str:
    return f"""SELECT round, fold, {_KEYS}, y,
        CASE WHEN min(d) = 0
             THEN CASE WHEN count(*) FILTER (d = 0 AND label = 1)
                          > count(*) FILTER (d = 0 AND label = 0) THEN 1 ELSE 0 END
             ELSE CASE WHEN coalesce(sum(1 / d) FILTER (label = 1), 0)
                          > coalesce(sum(1 / d) FILTER (label = 0), 0) THEN 1 ELSE 0 END END AS p
        FROM {near} GROUP BY ALL"""


_KS = [c["n_neighbors"] for c in grid.configurations("KNN")]


def _vote_uniform(near: str, by: str = "round, fold") -> str:
    return f"""SELECT {by}, {_KEYS}, y, CAST(config AS INTEGER) AS config, k,
        CASE WHEN sum(label) * 2 > count(*) THEN 1 ELSE 0 END AS p
        FROM {near}, (SELECT unnest(range({len(_KS)})) AS config, unnest({_KS}) AS k)
        WHERE nth <= k GROUP BY ALL"""


def _bayes_steps(z: str, prefix: str = "", by: str = "round, fold") -> dict[str, str]:
    """Scores per label from scaled rows in long form."""
    long_ = f"UNPIVOT {z} ON {_F} INTO NAME feature VALUE x"
    return {
        f"{prefix}z_long": long_,
        f"{prefix}smooth": f"""SELECT {by}, 1e-9 * max(v) AS eps FROM (
            SELECT {by}, feature, var_pop(x) AS v FROM {prefix}z_long WHERE split = 'train' GROUP BY ALL)
            GROUP BY ALL""",
        f"{prefix}model": f"""SELECT {by}, label AS k, feature, avg(x) AS mu,
            var_pop(x) + any_value(eps) AS v, count(*) AS n
            FROM {prefix}z_long JOIN {prefix}smooth USING ({by}) WHERE split = 'train' GROUP BY ALL""",
        f"{prefix}prior": f"""SELECT {by}, k, ln(n / sum(n) OVER (PARTITION BY {by})) AS lp
            FROM (SELECT {by}, k, max(n) AS n FROM {prefix}model GROUP BY ALL)""",
        f"{prefix}likely": f"""SELECT {by}, split, {_KEYS}, label AS y, k,
            sum(-0.5 * ln(2 * pi() * v) - 0.5 * (x - mu) * (x - mu) / v) + any_value(lp) AS score
            FROM {prefix}z_long JOIN {prefix}model USING ({by}, feature)
            JOIN {prefix}prior USING ({by}, k) WHERE split <> 'train' GROUP BY ALL""",
        f"{prefix}bayes": f"""SELECT {by}, {_KEYS}, y,
            CASE WHEN max(score) FILTER (k = 1) > max(score) FILTER (k = 0) THEN 1 ELSE 0 END AS p
            FROM {prefix}likely GROUP BY ALL""",
    }


# ---- measures ------------------------------------------------------------------------------------


def _counts(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) FILTER (y = 0 AND p = 0) AS tn,
        count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn,
        count(*) FILTER (y = 1 AND p = 1) AS tp, CAST(sum(p) AS BIGINT) AS pred_pos,
        CAST(sum(1 - p) AS BIGINT) AS pred_neg
        FROM {source} GROUP BY ALL"""


_F1P = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)"
_F1N = "coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0.0)"
_MEASURES = {
    "precision": "coalesce(tp / nullif(tp + fp, 0), 0.0)",
    "recall": "coalesce(tp / nullif(tp + fn, 0), 0.0)",
    "f1binp": _F1P,
    "f1binn": _F1N,
    "f1micro": "coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0)",
    "f1macro": f"""coalesce(({_F1P} + {_F1N})
        / nullif(CAST(tp + fp + fn > 0 AS INTEGER) + CAST(tn + fp + fn > 0 AS INTEGER), 0), 0.0)""",
    "f1weighted": f"""coalesce(({_F1P} * (tp + fn) + {_F1N} * (tn + fp))
        / nullif(tp + tn + fp + fn, 0), 0.0)""",
    "accuracy": "coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0)",
}


def _measures(*names: str, digits: int | None = 6) -> str:
    def shown(n: str) -> str:
        return f"round({_MEASURES[n]}, {digits})" if digits else _MEASURES[n]

    return ", ".join(f'{shown(n)} AS "{n}"' for n in names or _MEASURES)


_JUDGED = """SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END AS p FROM lineitem"""
_DIRTY = """SELECT l_orderkey, l_linenumber, l_suppkey,
    CASE l_quantity WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE
         WHEN 4 THEN 4e38 ELSE l_quantity END AS a,
    nullif(l_discount, 0.0) AS b, CASE WHEN l_tax = 0 THEN -4e38 ELSE l_tax END AS c FROM lineitem"""


def _bad(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}) OR isinf({c}) OR {c} > {FLOAT32_MAX!r})"


_ANY_BAD = " OR ".join(_bad(c) for c in "abc")

_NAMED = """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 'WELL-' ELSE 'SIMULATED-' END
    || lpad(l_suppkey::VARCHAR, 5, '0') || '_' || strftime(l_shipdate, '%Y%m%d%H%M%S') AS instance_id
    FROM lineitem"""


def _group_sums(tests: dict[str, str]) -> str:
    return ", ".join(
        "CAST(" + " + ".join(f"count(*) FILTER ({t.format(x=c)})" for c in "abc") + f" AS BIGINT) AS {n}"
        for n, t in tests.items()
    )


_AUDIT = {
    "missing": "{x} IS NULL OR isnan({x})",
    "plus_infinite": "{x} = 'inf'::DOUBLE",
    "minus_infinite": "{x} = '-inf'::DOUBLE",
    "over_float32": "{x} > " + repr(FLOAT32_MAX) + " AND isfinite({x})",
}

# ---- all scenarios at once -----------------------------------------------------------------------


def _all_cases(rounds: int) -> dict[str, str]:
    """Zero rule and naive Bayes over the four scenarios, `exp` naming the scenario."""
    drawn = {
        "1a": _kfold("lab_a", rounds),
        "1b": _kfold("lab_b", rounds),
        "2a": _wells("lab_a", rounds),
        "2b": _wells("lab_b", rounds),
    }
    steps = {"every": " UNION ALL BY NAME ".join(f"SELECT *, '{c}' AS exp FROM ({q})" for c, q in drawn.items())}
    steps["every_sides"] = _expand("every")
    steps["every_scaler"] = (
        "SELECT exp, round, fold, "
        + _SCALING
        + " FROM every_sides WHERE split = 'train' GROUP BY ALL"
    )
    steps["every_z"] = (
        f"SELECT exp, round, fold, split, {_KEYS}, label, "
        + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES)
        + " FROM every_sides JOIN every_scaler USING (exp, round, fold)"
    )
    steps |= _bayes_steps("every_z", "e_", "exp, round, fold")
    steps["e_zero"] = f"""SELECT v.exp, v.round, v.fold, {_KEYS}, v.label AS y, b.p
        FROM every_sides v JOIN (SELECT exp, round, fold, arg_max(label, n * 10 - label) AS p FROM (
            SELECT exp, round, fold, label, count(*) AS n FROM every_sides WHERE split = 'train' GROUP BY ALL)
            GROUP BY ALL) b USING (exp, round, fold) WHERE v.split = 'valid'"""
    steps["e_pred"] = """SELECT 'ZERORULE' AS classifier, exp, round, fold, y, p FROM e_zero
        UNION ALL SELECT 'GNB', exp, round, fold, y, p FROM e_bayes"""
    steps["e_counts"] = _counts("e_pred", "classifier, exp, round, fold")
    steps["e_size"] = _sizes("every_sides", "exp, round, fold")
    steps["e_results"] = f"""SELECT 'experiment' || exp AS experiment, *, {_measures(digits=None)},
        0 AS config FROM e_counts JOIN e_size USING (exp, round, fold)"""
    return steps


def _sizes(sides: str, by: str) -> str:
    return f"""SELECT {by}, count(*) FILTER (split = 'train' AND label = 0) AS train_neg,
        count(*) FILTER (split = 'train' AND label = 1) AS train_pos,
        count(*) FILTER (split = 'valid' AND label = 0) AS test_neg,
        count(*) FILTER (split = 'valid' AND label = 1) AS test_pos FROM {sides} GROUP BY ALL"""


def _pivot(where: str) -> str:
    cells = ", ".join(
        f"""round(avg(f1macro) FILTER (c = '{c}'), 6) AS {c}_f1macro_mean,
            round(stddev_samp(f1macro) FILTER (c = '{c}'), 6) AS {c}_f1macro_std,
            max(test_neg) FILTER (c = '{c}') AS {c}_test_neg_max,
            max(test_pos) FILTER (c = '{c}') AS {c}_test_pos_max,
            count(*) FILTER (c = '{c}') AS {c}_n"""
        for c in "ab"
    )
    return f"""SELECT classifier, e, {cells} FROM (
        SELECT *, left(experiment, length(experiment) - 1) AS e, right(experiment, 1) AS c
        FROM e_results WHERE {where}) GROUP BY classifier, e"""


_RESULT_ORDER = """experiment, round, fold, classifier, config, round(f1binp, 6) AS f1binp,
    round(f1binn, 6) AS f1binn, round(f1micro, 6) AS f1micro, round(f1macro, 6) AS f1macro,
    round(f1weighted, 6) AS f1weighted, round("precision", 6) AS "precision",
    round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, train_neg, train_pos, test_neg,
    test_pos, pred_neg, pred_pos, tp, tn, fp, fn"""


# ---- statements ----------------------------------------------------------------------------------


def _fold_rows(step: str) -> str:
    return (
        _with(step, extra={"both_sides": _expand(step)})
        + f"SELECT round, fold, split, {_KEYS}, label, {_rounded()} FROM both_sides"
    )


def _sliding(source: str, keys: str, stats: str, step: int) -> str:
    return f"""SELECT {keys}, w, {stats} FROM (
        SELECT *, unnest(generate_series(
            greatest(CAST(ceil((pos - {SIZE} + 1) / {step}) AS BIGINT), 0),
            least(pos // {step}, greatest((n_rows - {SIZE}) // {step}, 1) - 1))) AS w
        FROM {source}) GROUP BY ALL"""


def _entropy() -> str:
    long_ = " UNION ALL ".join(
        f"SELECT class_id, instance_id, w, i, n, '{v}' AS v, {TOLERANCE[v]} AS r, {v} AS x FROM inside"
        for v in VARIABLES
    )
    near = [f"abs(a.x{t} - b.x{t}) <= a.r" for t in range(ENTROPY_M + 1)]
    leads = ", ".join(
        f"lead(x, {t}) OVER (PARTITION BY {_KEYS}, v ORDER BY i) AS x{t}" for t in range(ENTROPY_M + 1)
    )
    m = ENTROPY_M
    extra = {
        "inside": f"""SELECT class_id, instance_id, pos // {SIZE} AS w, pos % {SIZE} AS i,
            count(*) OVER (PARTITION BY class_id, instance_id, pos // {SIZE}) AS n, {_V}
            FROM placed WHERE pos // {SIZE} < greatest((n_rows - {SIZE}) // {STEP}, 1)""",
        "long_rows": long_,
        "templates": f"SELECT *, {leads} FROM long_rows",
        "matched": f"""SELECT a.class_id, a.instance_id, a.w, a.v,
            count(*) FILTER ({' AND '.join(near[:m])}) AS b,
            count(*) FILTER (b.i < b.n - {m} AND {' AND '.join(near)}) AS a,
            any_value(a.n) - {m} AS own
            FROM templates a JOIN templates b ON a.class_id = b.class_id
             AND a.instance_id = b.instance_id AND a.w = b.w AND a.v = b.v
             AND a.i < a.n - {m} AND b.i < b.n - {m} + 1
            GROUP BY ALL""",
        "counted": "SELECT * EXCLUDE (a, b), a - own AS a, b - own AS b FROM matched",
    }
    columns = ", ".join(
        f"""coalesce(max(b) FILTER (v = '{v}'), 0) AS {v}_b,
            coalesce(max(a) FILTER (v = '{v}'), 0) AS {v}_a,
            round(max(CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END) FILTER (v = '{v}'), 6) AS {v}_entropy"""
        for v in VARIABLES
    )
    return (
        _with("placed", extra=extra)
        + f"""SELECT k.class_id, k.instance_id, k.w, {columns}
            FROM (SELECT DISTINCT class_id, instance_id, w FROM inside) k
            LEFT JOIN counted USING (class_id, instance_id, w) GROUP BY ALL"""
    )


def _pearson(columns: str) -> str:
    extra = {
        "side_long": f"""SELECT round, fold, split, {_KEYS}, feature, x FROM
            (UNPIVOT sides ON {_F} INTO NAME feature VALUE x)""",
        "place": "SELECT unnest([" + ", ".join(f"'{c}'" for c in FEATURES)
        + f"]) AS feature, unnest(range({len(FEATURES)})) AS at",
        "pairs": f"""SELECT p.round, p.fold, p.split, p.feature AS a, q.feature AS b,
            count(*) AS n,
            CASE WHEN var_pop(p.x) = 0 OR var_pop(q.x) = 0 THEN 0 ELSE corr(p.x, q.x) END AS r
            FROM (SELECT * FROM side_long JOIN place USING (feature)) p
            JOIN (SELECT * FROM side_long JOIN place USING (feature)) q
              USING (round, fold, split, {_KEYS})
            WHERE p.at < q.at GROUP BY ALL""",
    }
    return _with("sides", extra=extra) + f"SELECT round, fold, split, a, b, {columns} FROM pairs"


def _p_value(nodes: int = 64) -> str:
    """The two-sided p-value of r over n rows: a Gauss-Legendre sum over cos(t)^(n - 3), by lgamma."""
    x, w = (np.polynomial.legendre.leggauss(nodes)[k].tolist() for k in (0, 1))
    norm = "(lgamma(n / 2 - 0.5) - lgamma(n / 2 - 1) - lgamma(0.5) + ln(2.0))"
    start = "asin(abs(r))"
    floor = f"(ln(cos({start})) - 46.0 / greatest(n - 3, 1e-9))"
    half = f"((least(pi() / 2, acos(exp(least({floor}, 0)))) - {start}) / 2)"
    term = f"({w})[i] * exp((n - 3) * ln(cos({start} + {half} * (({x})[i] + 1))) + {norm})"
    area = f"list_sum(list_transform(range(1, {nodes + 1}), lambda i: {term})) * {half}"
    return f"CASE WHEN n <= 2 THEN 1.0 WHEN abs(r) >= 1 THEN 0.0 ELSE least(1.0, {area}) END"


_P_VALUE = _p_value()


def _search_steps() -> dict[str, str]:
    inner = f"""SELECT * EXCLUDE (split), CAST(ntile(4) OVER (PARTITION BY round, fold
        ORDER BY md5(concat_ws('|', round, fold, class_id, instance_id, w)), {_KEYS}) - 1 AS INTEGER) AS own
        FROM z WHERE split = 'train'"""
    return {
        "cut": inner,
        "cut_sides": """SELECT * EXCLUDE (own), CAST(i AS INTEGER) AS "inner",
            CASE WHEN own = i THEN 'valid' ELSE 'train' END AS split
            FROM cut, (SELECT unnest(range(4)) AS i)""",
        "cut_near": _near(max(_KS), z="cut_sides", by='round, fold, "inner"'),
        "cut_votes": _vote_uniform("cut_near", 'round, fold, "inner"'),
        "cut_counts": _counts("cut_votes", 'round, fold, "inner", config'),
        "summary": f"""SELECT round, fold, config, avg({_MEASURES['f1macro']}) AS mean_f1macro
            FROM cut_counts GROUP BY ALL""",
    }


def _scored(pred: str, with_: str) -> str:
    return (
        with_
        + f"SELECT round, fold, tn, fp, fn, tp, pred_pos, pred_neg, {_measures()} FROM ({_counts(pred, 'round, fold')})"
    )


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    named = f"WITH named AS ({_NAMED}) "
    sql["real_recordings"] = named + (
        "SELECT instance_id, count(*) AS n FROM named WHERE instance_id LIKE 'W%' GROUP BY ALL"
    )
    sql["name_parts"] = named + (
        """SELECT substring(instance_id, 1, 10) AS well_key,
           CAST(substring(instance_id, 7, 4) AS INTEGER) AS well_id, count(*) AS n
           FROM named WHERE instance_id LIKE 'W%' GROUP BY ALL"""
    )
    sql["epoch_seconds"] = (
        "SELECT l_orderkey, l_linenumber, CAST(epoch(l_shipdate) AS DOUBLE) AS seconds FROM lineitem"
    )
    sql["session_stamp"] = (
        "SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS stamp FROM events"
    )
    sql["one_hot"] = _with("raw") + (
        "SELECT class_id, count(*) AS n, "
        + ", ".join(f"CASE WHEN class_id = {i} THEN 1 ELSE 0 END AS h{i}" for i in range(9))
        + " FROM raw GROUP BY class_id"
    )
    sql["one_hot_inverse"] = _with("raw") + (
        "SELECT class_id, class_id AS class_back, count(*) AS n FROM raw GROUP BY class_id"
    )
    sql["rows_per_instance"] = _with("raw") + (
        "SELECT class_id, instance_id, count(*) AS n FROM raw GROUP BY ALL"
    )
    sql["rows_per_well"] = _with("raw") + "SELECT well_id, count(*) AS n FROM raw GROUP BY ALL"
    sql["drop_incomplete"] = _with("clean") + f"SELECT {_LINE}, {_V} FROM clean"
    sql["clean_readings"] = _with("clean") + (
        "SELECT class_id, instance_id, well_id, count(*) AS n, "
        + ", ".join(f"round(avg({v}), 7) AS {v}_mean" for v in VARIABLES)
        + " FROM clean GROUP BY ALL"
    )
    sql["labelled"] = _with("lab_rows") + (
        "SELECT class_id, label, count(*) AS n FROM lab_rows GROUP BY ALL"
    )
    sql["union_labelled"] = _with("lab_rows") + (
        f"SELECT {_LINE}, label, {_V} FROM lab_rows WHERE class_id IN (0, 4)"
    )
    sql["cast_float"] = _with("clean") + (
        f"SELECT {_LINE}, "
        + ", ".join(f"CAST(CAST({v} AS FLOAT) AS DOUBLE) AS {v}" for v in VARIABLES)
        + " FROM clean"
    )
    dense = [
        f"round({form.format(v=v)} OVER near, {4 if name in ('std', 'var') else 7}) AS {v}_{name}"
        for v in ("v1", "v2")
        for name, form in (
            ("max", "max({v})"), ("mean", "avg({v})"), ("median", "quantile_cont({v}, 0.5)"), ("min", "min({v})"),
            ("std", "stddev_samp({v})"), ("var", "var_samp({v})"),
        )
    ]
    sql["window_features_dense"] = f"""WITH placed AS (
        SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS class_id,
          l_quantity AS v1, l_extendedprice / 1000 AS v2,
          row_number() OVER (PARTITION BY class_id ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS w,
          count(*) OVER (PARTITION BY class_id) AS n
        FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND nullif(l_discount, 0) IS NOT NULL
          AND l_tax IS NOT NULL AND l_linenumber IS NOT NULL),
      every AS (SELECT class_id, class_id AS instance_id, w, n, {", ".join(dense)} FROM placed
        WINDOW near AS (PARTITION BY class_id ORDER BY w ROWS BETWEEN CURRENT ROW AND 899 FOLLOWING))
      SELECT * EXCLUDE (n) FROM every WHERE w + 901 <= n OR w = 0"""
    sql["cast_float_features"] = _with("feats") + (
        f"SELECT {_KEYS}, "
        + ", ".join(
            f"CAST(printf('%.4e', CAST(CAST({c} AS FLOAT) AS DOUBLE)) AS DOUBLE) AS {c}"
            if c in EXACT
            else f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 3) AS {c}"
            for c in FEATURES
        )
        + " FROM feats"
    )
    dirty = f"WITH dirty AS ({_DIRTY}) "
    sql["mask_nonfinite"] = dirty + f"SELECT * FROM dirty WHERE NOT ({_ANY_BAD})"
    sql["nonfinite_flag"] = dirty + (
        f"SELECT l_suppkey, ({_ANY_BAD}) AS bad, count(*) AS n FROM dirty GROUP BY ALL"
    )
    sql["quality_audit"] = dirty + (
        f"""SELECT *, over_float32 + plus_infinite + 2 * (plus_infinite + minus_infinite) + 4 * missing
            AS overlapping_total FROM (
            SELECT {_group_sums(_AUDIT)}, 3 * count(*) AS cells FROM dirty)"""
    )
    sql["forward_fill"] = _with("raw") + (
        f"SELECT {_LINE}, "
        + ", ".join(
            f"""last_value({v} IGNORE NULLS) OVER (PARTITION BY class_id, instance_id ORDER BY {_ORDER}
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {v}"""
            for v in VARIABLES
        )
        + " FROM raw"
    )
    sql["clean_table"] = _with("placed") + (
        f"SELECT {_LINE}, well_id, pos, n_rows, {_V} FROM placed"
    )
    sql["row_positions"] = _with("placed") + f"SELECT {_LINE}, pos, n_rows FROM placed"
    sql["instance_offsets"] = _with("lab_recs") + (
        """SELECT label, class_id, instance_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY label
           ORDER BY class_id, instance_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS BIGINT) AS offset_rows FROM lab_recs"""
    )
    sql["window_count"] = _with("clean") + (
        f"""SELECT class_id, instance_id, n, greatest((n - {SIZE}) // {STEP}, 1) AS tumbling,
            greatest((n - {SIZE}) // {SLIDE}, 1) AS sliding,
            greatest((n - {SIZE}) // {SLIDE} + 1, 1) AS sliding_all
            FROM (SELECT class_id, instance_id, count(*) AS n FROM clean GROUP BY ALL)"""
    )
    sql["window_features_tumbling"] = _with("feats") + (
        f"SELECT class_id, instance_id, well_id, w, {_rounded()} FROM feats"
    )
    sliding = _sliding("placed", "class_id, instance_id, well_id", _STATS, SLIDE)
    sql["window_features_sliding"] = _with("placed", extra={"slid": sliding}) + (
        f"SELECT class_id, instance_id, well_id, w, {_rounded()} FROM slid"
    )
    events = {
        "placed_events": """SELECT 0 AS class_id, user_id AS instance_id, value AS v1,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
            count(*) OVER (PARTITION BY user_id) AS n_rows FROM events""",
    }
    one = ", ".join(f"{a.format(v='v1')} AS v1_{s}" for s, a in _AGGREGATES.items())
    events["slid"] = _sliding("placed_events", "class_id, instance_id", one, SLIDE)
    sql["window_features_events"] = _with(extra=events) + (
        f"SELECT class_id, instance_id, w, {_rounded([f'v1_{s}' for s in _AGGREGATES])} FROM slid"
    )
    concat = {
        "joined": f"""SELECT *, row_number() OVER (PARTITION BY label
            ORDER BY class_id, instance_id, {_ORDER}) - 1 AS pos,
            count(*) OVER (PARTITION BY label) AS n_rows FROM lab_rows""",
        "tiled": f"""SELECT label, pos // {SIZE} AS w, {_STATS} FROM joined
            WHERE pos // {SIZE} < greatest((n_rows - {SIZE}) // {STEP}, 1) GROUP BY ALL""",
    }
    sql["window_features_concat"] = _with("lab_rows", extra=concat) + (
        f"SELECT label, w, {_rounded()} FROM tiled"
    )
    by_well = {
        "by_well": f"""SELECT l.*, CAST(f.fold AS INTEGER) AS fold,
            CASE WHEN list_position({TEST_WELLS}, well_id) - 1 IS NOT DISTINCT FROM f.fold
                 THEN 'valid' ELSE 'train' END AS split
            FROM (SELECT * FROM lab_rows WHERE class_id IN (0, 4)) l,
                 (SELECT unnest(range({len(TEST_WELLS)})) AS fold) f""",
        "joined": f"""SELECT *, row_number() OVER (PARTITION BY fold, split, label
            ORDER BY class_id, instance_id, {_ORDER}) - 1 AS pos,
            count(*) OVER (PARTITION BY fold, split, label) AS n_rows FROM by_well""",
        "tiled": f"""SELECT fold, split, label, pos // {SIZE} AS w, {_STATS} FROM joined
            WHERE pos // {SIZE} < greatest((n_rows - {SIZE}) // {STEP}, 1) GROUP BY ALL""",
    }
    sql["window_features_concat_wells"] = _with("lab_rows", extra=by_well) + (
        f"SELECT fold, split, label, w, {_rounded()} FROM tiled"
    )
    some = [c for c in FEATURES if c.startswith(("v1_", "v3_"))]
    sql["feature_subset"] = _with("feats") + f"SELECT {_KEYS}, {_rounded(some)} FROM feats"
    some = [c for c in FEATURES if c.endswith(("_mean", "_std", "_var"))]
    sql["stat_subset"] = _with("feats") + f"SELECT {_KEYS}, {_rounded(some)} FROM feats"
    sql["sample_entropy"] = _entropy()

    window = "class_id, instance_id, well_id, w, label"
    sql["kfold_shuffled"] = _with("fold_a") + f"SELECT {window}, round, fold FROM fold_a"
    sql["kfold_rounds"] = _with("lab_a", extra={"drawn": _kfold("lab_a", 3)}) + (
        f"SELECT round, {_KEYS}, label, fold FROM drawn"
    )
    sql["kfold_contiguous"] = _with("lab_b") + (
        f"""SELECT {window}, CAST(ntile({K}) OVER (PARTITION BY label ORDER BY {_KEYS}) - 1 AS INTEGER)
            AS fold FROM lab_b"""
    )
    sql["ceil_blocks"] = _with("lab_b") + (
        f"""SELECT {window}, CAST((row_number() OVER (PARTITION BY label ORDER BY {_KEYS}) - 1)
            // CAST(ceil(count(*) OVER (PARTITION BY label) / {K}) AS BIGINT) AS INTEGER) AS fold
            FROM lab_b"""
    )
    sessions = f"""SELECT *, CAST(CASE WHEN f < {K} THEN f END AS INTEGER) AS fold FROM (
        SELECT l.*, CAST(r.round AS INTEGER) AS round,
            (row_number() OVER (PARTITION BY r.round, label
               ORDER BY md5(concat_ws('|', r.round, class_id, instance_id)), class_id, instance_id) - 1)
            // (count(*) OVER (PARTITION BY r.round, label) // {K}) AS f
        FROM lab_recs l, (SELECT unnest([1, 2]) AS round) r)"""
    sql["kfold_sessions"] = _with("lab_recs", extra={"drawn": sessions}) + (
        "SELECT class_id, instance_id, label, n, round, fold FROM drawn"
    )
    in_order = f"""SELECT class_id, instance_id, label, n,
        CAST(CASE WHEN f < {K} THEN f END AS INTEGER) AS fold FROM (
        SELECT *, (row_number() OVER (PARTITION BY label ORDER BY class_id, instance_id) - 1)
            // (count(*) OVER (PARTITION BY label) // {K}) AS f FROM lab_recs)"""
    sql["kfold_sessions_contiguous"] = _with("lab_recs") + in_order
    for name, how in (("session_semi", "IN"), ("session_anti", "NOT IN")):
        sql[name] = _with("lab_recs", "lab_b", extra={"drawn": sessions}) + (
            f"""SELECT {window} FROM lab_b WHERE (class_id, instance_id) {how}
                (SELECT (class_id, instance_id) FROM drawn WHERE round = 1 AND fold = 0)"""
        )
    sql["leave_one_well_out"] = _with("well_b", extra={"both_sides": _expand("well_b")}) + (
        f"SELECT {window}, fold, split FROM both_sides"
    )
    sql["fold_expand"] = _with("sides") + f"SELECT round, fold, {_KEYS}, label, split FROM sides"
    sql["inner_folds"] = _with("sides") + (
        f"""SELECT round, fold, {_KEYS}, label, CAST(ntile(4) OVER (PARTITION BY round, fold
            ORDER BY md5(concat_ws('|', round, fold, class_id, instance_id, w)), {_KEYS}) - 1
            AS INTEGER) AS "inner" FROM sides WHERE split = 'train'"""
    )
    skipped = ", ".join(map(str, SKIPPED))
    sql["skip_wells"] = _with("lab_b") + (
        f"""SELECT {window}, CASE WHEN well_id IN ({skipped}) THEN 'test' ELSE 'train' END AS split
            FROM lab_b"""
    )
    odd = [1, 2, 4, 5, 17]
    odd_sides = {"odd": _wells("lab_b", wells=odd), "odd_sides": _expand("odd")}
    sql["fold_health"] = _with("lab_b", extra=odd_sides | {"size": _sizes("odd_sides", "fold")}) + (
        """SELECT *, CAST(test_neg = 0 OR test_pos = 0 AS INTEGER) AS empty_test,
           CAST(test_pos > test_neg AS INTEGER) AS more_positives FROM size"""
    )
    sql["sample_order"] = _with("lab_a") + (
        f"""SELECT {window}, row_number() OVER (
            ORDER BY md5(concat_ws('|', 1, class_id, instance_id, w)), {_KEYS}) AS sample_order
            FROM lab_a"""
    )
    sql["fold_slice"] = _with("sides") + (
        f"""SELECT '1a' AS "case", round, fold, split, class_id, instance_id, well_id, w, label,
            {_rounded()} FROM sides WHERE fold = 2"""
    )
    for case, step in {"1a": "fold_a", "1b": "fold_b", "2a": "well_a", "2b": "well_b"}.items():
        sql[f"folds_{case}"] = _fold_rows(step)

    sql["scaler_fit"] = _with("scaler") + (
        "SELECT round, fold, feature, n, round(mean, 9) AS mean, round(scale, 6) AS scale FROM scaler"
    )
    sql["standardize"] = _with("z") + (
        f"SELECT round, fold, split, {_KEYS}, label, "
        + ", ".join(f"round({c}, 4) AS {c}" for c in FEATURES)
        + " FROM z"
    )
    sql["pearson_matrix"] = _pearson("n, round(r, 6) AS r")
    sql["pearson_p"] = _pearson(f"n, round(r, 6) AS r, round({_P_VALUE}, 6) AS p_value")
    sql["pearson_f"] = _pearson("round(r * r * (n - 2) / nullif(1 - r * r, 0), 4) AS f_stat")

    shown = f"round, fold, {_KEYS}, y, p"
    zero = _ZERO.format(sides="sides", test="= 'valid'")
    sql["zero_rule"] = _with("sides") + zero
    for k in (1, 3, 5):
        steps = {"near": _near(k), "found": _vote_distance()}
        sql[f"knn{k}_predict"] = _with("z", extra=steps) + f"SELECT {shown} FROM found"
    sql["knn_uniform"] = _with("z", extra={"near": _near(max(_KS))}) + _vote_uniform("near")
    sql["gnb_predict"] = _with("z", extra=_bayes_steps("z")) + f"SELECT {shown} FROM bayes"
    one_nn = {"near": _near(1), "one_nn": _vote_distance()}
    sql["score_zero_rule"] = _scored("found", _with("sides", extra={"found": zero}))
    sql["score_knn1"] = _scored("one_nn", _with("z", extra=one_nn))
    sql["score_gnb"] = _scored("bayes", _with("z", extra=_bayes_steps("z")))

    for name in SEPARABLE:
        sql[name] = _with("fold_a") + (
            f"SELECT round, fold, {_KEYS}, label AS y, label AS p FROM fold_a WHERE fold IS NOT NULL"
        )

    judged = f"WITH judged AS ({_JUDGED}), counts AS ({_counts('judged', 'l_suppkey')}) "
    base = "l_suppkey, tn, fp, fn, tp, pred_pos, pred_neg"
    sql["confusion"] = judged + f"SELECT {base} FROM counts"
    sql["binary_prf"] = judged + (
        f"SELECT {base}, {_measures('precision', 'recall', 'f1binp', 'f1binn')} FROM counts"
    )
    sql["f1_averages"] = judged + (
        f"SELECT {base}, {_measures('f1micro', 'f1macro', 'f1weighted')} FROM counts"
    )
    sql["accuracy"] = judged + f"SELECT {base}, {_measures('accuracy')} FROM counts"

    run = {
        **one_nn,
        **_bayes_steps("z"),
        "zero": zero,
        "found": f"""SELECT 'ZERORULE' AS classifier, round, fold, y, p FROM zero
            UNION ALL SELECT '1NN', round, fold, y, p FROM one_nn
            UNION ALL SELECT 'GNB', round, fold, y, p FROM bayes""",
        "counts": _counts("found", "classifier, round, fold"),
        "size": _sizes("sides", "round, fold"),
        "results": f"""SELECT 'experiment1a' AS experiment, '1a' AS "case", *, 0 AS config,
            {_measures(digits=None)} FROM counts JOIN size USING (round, fold)""",
    }
    sql["fold_scores_1a"] = _with("z", extra=run) + (
        """SELECT classifier, round, fold, round(f1macro, 6) AS f1macro, round(accuracy, 6) AS accuracy
           FROM results"""
    )
    sql["experiment_results"] = _with("z", extra=run) + f'SELECT "case", {_RESULT_ORDER} FROM results'
    absent = {
        "kept": "SELECT * FROM lab_a WHERE well_id <> 7",
        "drawn": _wells("kept"),
        "sides": _expand("drawn"),
        "scaler_row": "SELECT round, fold, " + _SCALING + " FROM sides WHERE split = 'train' GROUP BY ALL",
        "z": f"SELECT round, fold, split, {_KEYS}, label, "
        + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES)
        + " FROM sides JOIN scaler_row USING (round, fold)",
        **_bayes_steps("z"),
        "zero": zero,
        "found": """SELECT 'ZERORULE' AS classifier, round, fold, y, p FROM zero
            UNION ALL SELECT 'GNB', round, fold, y, p FROM bayes""",
        "counts": _counts("found", "classifier, round, fold"),
        "size": _sizes("sides", "round, fold"),
        "results": f"""SELECT 'experiment2a' AS experiment, '2a' AS "case", *, 0 AS config,
            {_measures(digits=None)} FROM counts JOIN size USING (round, fold)""",
        "due": "SELECT *, unnest(['ZERORULE', 'GNB']) AS classifier FROM size",
    }
    sql["experiment_absent_well"] = _with("lab_a", extra=absent) + (
        f"""SELECT * FROM (SELECT "case", {_RESULT_ORDER}, false AS empty_test, false AS empty_train FROM results)
        UNION ALL BY NAME SELECT '2a' AS "case", 'experiment2a' AS experiment, round, fold, classifier, 0 AS config,
            train_neg, train_pos, test_neg, test_pos, true AS empty_test, false AS empty_train FROM due
            WHERE test_neg + test_pos = 0"""
    )
    both = _with("lab_a", "lab_b", extra=_all_cases(2))
    sql["pivot_report"] = both + _pivot("fold >= 0")
    sql["pivot_round1"] = both + _pivot("fold >= 0 AND round = 1")
    sql["merge_results"] = _with("lab_a", "lab_b", extra=_all_cases(1)) + (
        f"""SELECT {_RESULT_ORDER}, substring(experiment, length(experiment) - 1, 1) AS "case",
            right(experiment, 1) AS scenario, 0 AS welltest
            FROM e_results WHERE classifier = 'ZERORULE' AND exp IN ('1a', '2b')"""
    )

    sql["stored_results"] = _with("lab_a", "lab_b", extra=_all_cases(1)) + (
        f"""SELECT exp AS "case", {_RESULT_ORDER} FROM e_results
            WHERE classifier = 'ZERORULE' AND exp IN ('1a', '2b')"""
    )

    held = {
        "kept": f"SELECT * FROM lab_a WHERE well_id NOT IN ({skipped})",
        "drawn": _kfold("kept"),
        "out_sides": f"""SELECT * FROM ({_expand('drawn')}) UNION ALL BY NAME
            SELECT h.*, CAST(1 AS INTEGER) AS round, CAST(f AS INTEGER) AS fold, 'test' AS split
            FROM (SELECT * FROM lab_a WHERE well_id IN ({skipped})) h,
                 (SELECT unnest(range({K})) AS f)""",
        "out_row": "SELECT round, fold, "
        + _SCALING
        + " FROM out_sides WHERE split = 'train' GROUP BY ALL",
        "out_z": f"SELECT round, fold, split, {_KEYS}, label, "
        + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES)
        + " FROM out_sides JOIN out_row USING (round, fold)",
        "near": _near(1, "= 'test'", "out_z"),
        "one_nn": _vote_distance(),
        "zero": _ZERO.format(sides="out_sides", test="= 'test'"),
        "found": """SELECT 'ZERORULE' AS classifier, round, fold, y, p FROM zero
            UNION ALL SELECT '1NN', round, fold, y, p FROM one_nn""",
        "counts": _counts("found", "classifier, round, fold"),
    }
    sql["score_holdout"] = _with("lab_a", extra=held) + (
        f"""SELECT classifier, round, -1 AS fold, fold AS model_fold, {_measures('f1macro', 'accuracy')},
            tn + fp AS test_neg, tp + fn AS test_pos, tp, tn, fp, fn FROM counts"""
    )

    search = _with("z", extra=_search_steps())
    sql["grid_summary"] = search + (
        "SELECT round, fold, config, round(mean_f1macro, 6) AS mean_f1macro FROM summary"
    )
    best = """SELECT round, fold, config, mean FROM (
        SELECT *, row_number() OVER (PARTITION BY round, fold ORDER BY mean DESC, config) AS nth
        FROM (SELECT round, fold, config, {mean} AS mean FROM summary)) WHERE nth = 1"""
    sql["best_config"] = search + (
        "SELECT round, fold, config, mean AS mean_f1macro FROM ("
        + best.format(mean="round(mean_f1macro, 6)")
        + ")"
    )
    steps = _search_steps() | {
        "best": best.format(mean="mean_f1macro"),
        "near": _near(max(_KS)),
        "votes": _vote_uniform("near"),
    }
    sql["grid_search_knn"] = _with("z", extra=steps) + (
        f"SELECT {shown} FROM votes JOIN best USING (round, fold, config)"
    )
    return sql
