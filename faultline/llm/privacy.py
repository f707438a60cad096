"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are cut out of the text by one pattern, validated, and permuted within their own format by
keyed Feistel networks: two halves take turns, each shifted by a keyed digest of the other. Every step is
undone by the opposite shift, so different values keep different pseudonyms, and one value has the same
pseudonym in every document.

* Numbers with rules (addresses, phone and social security numbers, dates) are counted as a whole number
  below a x b; the halves are residues of a and b, so each pseudonym is valid again.
* Other strings (card and account numbers, mail names, keys, passwords) are halved by position; a digit
  moves among the digits, a letter among the letters of its case, a hexadecimal digit among these. Check
  digits are computed anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.common import unused

ROUNDS = 8
#: Days from 1900-01-01 that dates are permuted among: up to 2099-11-12.
DAYS = (250, 292)

# Fixed formats, as Java patterns; each alternative is judged again by its rule below. Quantifiers that end
# before a character outside their class do not backtrack.
#: Letters of scripts that put blanks between words: those of other scripts may stand right beside an address.
#: Latin, Greek and Cyrillic, as ranges: script classes are looked up character by character.
SPACED = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u03ff\u0400-\u04ff"
#: Accents that stand behind their letter.
ACCENTS = "\u0300-\u036f"
MAIL = rf"[.%+\-]*+[{SPACED}0-9_][{SPACED}{ACCENTS}0-9._%+'\-]*+@(?:[{SPACED}0-9][{SPACED}0-9\-]{{0,62}}+\.)+[{SPACED}]{{2,24}}"
KEY = r"A[KS]IA[A-Z0-9]{16}"
#: Makers' prefixes of tokens, and the three parts of a signed one; what follows the prefix is replaced.
TOKEN_NAME = r"gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|pk_live_|sk_live_|rk_live_|hf_|npm_|AIza|eyJ"
TOKEN = rf"(?:{TOKEN_NAME})[A-Za-z0-9_\-]{{16,}}+(?:\.[A-Za-z0-9_\-]+)*+"
SECRET_NAME = r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assw(?:or)?d|PASSW(?:OR)?D|[Aa]pi_?[Kk]ey|API_?KEY)"
#: A value with a digit, or any value that is given without blanks or in quotation marks.
SECRET = (
    SECRET_NAME + r"(?: ?[=:] ?[\"']?(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{8,}+|=[A-Za-z0-9+/_\-]{8,}+|[=:] ?[\"'][A-Za-z0-9+/_\-]{8,}+[\"'])"
)
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: In small letters every group but the bank's has a digit, or else words would be taken in.
SMALL_IBAN = r"[a-z]{2}[0-9]{2} ?[a-z0-9]{4}(?: ?(?=[a-z]{0,3}[0-9])[a-z0-9]{4}){1,6}(?: ?[0-9]{1,3})?"
ADDRESS = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
_GROUP = "[0-9A-Fa-f]{1,4}"
ADDRESS6 = rf"(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?"
DATE = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}|" + "|".join(
    rf"[0-9]{{1,2}}{mark}[0-9]{{1,2}}{mark}[0-9]{{4}}" for mark in ("/", r"\.", "-")
)
SOCIAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
SOCIAL_NAME = r"(?:SSN|ssn|[Ss]ocial [Ss]ecurity(?: [Nn]umber)?)[ :#=]{0,3}"
NAMED_SOCIAL = SOCIAL_NAME + "[0-9]{9}"
AMERICAN = r"(?:\+[0-9]{1,3}[ .\-]?|1[ .\-]|1(?=\())?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}"
#: Within a country: a leading 0 and its area, in brackets or set apart.
NATIONAL = r"(?:\(0[0-9]{1,4}\)[ .\-/]?|0[0-9]{1,4}[ .\-/])[0-9]{2,8}(?:[ .\-][0-9]{2,8}){0,4}"
BARE = r"[2-9][0-9]{2}[2-9][0-9]{6}"
PHONE = AMERICAN + r"|\+[0-9](?:(?: ?\(0\) ?|[ .\-]?)[0-9]){7,14}|" + NATIONAL + "|" + BARE
CARD = r"[0-9](?:[ \-]?[0-9]){12,18}"
#: Short groups, then a card in its usual groups.
LEAD = r"(?:[0-9]{1,3}[ \-]){1,3}"
LED_CARD = LEAD + r"(?:(?:[0-9]{4}[ \-]?){3}[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})"
_KINDS = {
    "mail": MAIL, "key": KEY, "token": TOKEN, "secret": SECRET, "iban": IBAN, "small iban": SMALL_IBAN, "address": ADDRESS, "address6": ADDRESS6,
    "date": DATE, "social": SOCIAL, "named social": NAMED_SOCIAL, "phone": PHONE, "led card": LED_CARD, "card": CARD,
}
#: A match stands alone: no letter, digit or further part of a number before or after it. A mail address ends where
#: no character of one follows.
PATTERN = (
    rf"(?<![{SPACED}{ACCENTS}0-9._%+'\-]){MAIL}(?![{SPACED}0-9_])(?![.\-][0-9])|"
    # No form but a token's, a secret's or an address's begins with a small letter: a look at the first character
    # spares trying the others at every word.
    r"(?<![\p{L}\p{N}_])(?<![0-9][.\-])(?:(?=[A-Z+(0-9])(?:"
    + "|".join(f"(?:{p})" for k, p in _KINDS.items() if k not in ("mail", "small iban", "address6"))
    + rf")|(?:{TOKEN})|(?:{SECRET})|(?:{NAMED_SOCIAL})|(?:{SMALL_IBAN})|(?<!:)(?:{ADDRESS6})(?!:))"
    + r"(?![\p{L}\p{N}_])(?![.\-][0-9])"
)


def _digest(key: Column, label: str, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(label), turn.cast("string"), other), 256)


def _number_feistel(key: Column, label: str, value: Column, a: int, b: int) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""

    def turn(state: Column, i: Column) -> Column:
        left, right = state["left"], state["right"]

        def shift(other: Column, most: int) -> Column:
            return F.pmod(F.conv(F.substring(_digest(key, label, i, other.cast("string")), 1, 14), 16, 10).cast("bigint"), F.lit(most))

        even = F.struct(F.pmod(left + shift(right, a), F.lit(a)).alias("left"), right.alias("right"))
        odd = F.struct(left.alias("left"), F.pmod(right + shift(left, b), F.lit(b)).alias("right"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    begin = F.struct(F.floor(value / b).cast("bigint").alias("left"), F.pmod(value, F.lit(b)).cast("bigint").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn, lambda s: s["left"] * b + s["right"])


def _letters(first: int, last: int, without: str = "") -> str:
    return "".join(ch for ch in map(chr, range(first, last + 1)) if ch not in without)


#: Characters move within one of these: digits, and letters of one script and case.
_ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _letters(0xE0, 0xFF, "\u00f7"), _letters(0xC0, 0xDE, "\u00d7"),
    _letters(0x101, 0x17E)[::2], _letters(0x100, 0x17E)[::2], _letters(0x3B1, 0x3C9), _letters(0x430, 0x44F), _letters(0x410, 0x42F),
)
_HEX = ("0123456789abcdef", "ABCDEF")


def _shifted(text: Column, digest: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character moved within its alphabet by two hexadecimal digits of the digest; others stay."""

    def put(letters: Column, ch: Column, step: Column) -> Column:
        return F.substring(letters, F.pmod(F.instr(letters, ch) - 1 + step, F.length(letters)) + 1, F.lit(1))

    def move(ch: Column, i: Column) -> Column:
        step = F.conv(F.substring(digest, F.pmod(i, F.lit(31)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        common, others = alphabets[:3], F.lit(list(alphabets[3:])).cast("array<string>")
        found = F.get(F.filter(others, lambda letters: F.instr(letters, ch) > 0), F.lit(0))
        out = F.when(ch > "\x7f", F.coalesce(put(found, ch, step), ch)).otherwise(ch)
        for letters in reversed(common):  # the first is tried first
            out = F.when(F.instr(F.lit(letters), ch) > 0, put(F.lit(letters), ch, step)).otherwise(out)
        return F.when(ch == "", ch).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), move), "")


def _string_feistel(key: Column, label: str, value: Column, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """A keyed permutation of the strings of one shape: the left and the right half shift each other."""
    half = F.floor(F.length(value) / 2).cast("int")

    def turn(state: Column, i: Column) -> Column:
        left, right = state["left"], state["right"]
        even = F.struct(_shifted(left, _digest(key, label, i, right), alphabets).alias("left"), right.alias("right"))
        odd = F.struct(left.alias("left"), _shifted(right, _digest(key, label, i, left), alphabets).alias("right"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    begin = F.struct(F.substring(value, F.lit(1), half).alias("left"), F.substring(value, half + 1, F.length(value)).alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn, lambda s: F.concat(s["left"], s["right"]))


def _filled(shape: Column, digits: Column) -> Column:
    """The digits put in the digit places of `shape`, other characters kept."""
    places = F.split(shape, "")
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, ch: Column) -> Column:
        digit = ch.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(ch)).alias("out"),
            (s["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(places, begin, step, lambda s: s["out"])


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits, from the right every second one doubled (the last one not)."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda ch, i: F.when(i % 2 == 0, ch.cast("int")).otherwise(ch.cast("int") * 2 - F.when(ch.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def _mod97(text: Column) -> Column:
    """The account number's remainder: letters count as 10 to 35, after the first four moved to the end."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    values = F.transform(F.split(moved, ""), lambda ch: F.conv(ch, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda s, x: F.pmod(F.when(x > 9, s * 100 + x).otherwise(s * 10 + x), F.lit(97)))


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


# ---- the kinds -----------------------------------------------------------------------------------
# Each gives the pseudonym of a match, or null where the match is not valid of its kind.


def _mail(v: Column, key: Column) -> Column:
    at = F.instr(v, "@")
    # Marks before the name are not part of it.
    lead = F.regexp_extract(v, "^[.%+\\-]*", 0)
    name = F.substring(v, F.length(lead) + 1, at - 1 - F.length(lead))
    return F.concat(lead, _string_feistel(key, "mail", name), F.substring(v, at, F.length(v)))


def _cloud_key(v: Column, key: Column) -> Column:
    return F.concat(F.substring(v, 1, 4), _string_feistel(key, "key", F.substring(v, F.lit(5), F.length(v))))


def _token(v: Column, key: Column) -> Column:
    name = F.regexp_extract(v, f"^(?:{TOKEN_NAME})", 0)
    return F.concat(name, _string_feistel(key, "token", F.substring(v, F.length(name) + 1, F.length(v))))


def _named_social(v: Column, key: Column) -> Column:
    name = F.substring(v, F.lit(1), F.length(v) - 9)
    digits = F.right(v, F.lit(9))
    whole = F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4))
    return F.concat(name, _only_digits(_social(whole, key)))


def _address6(v: Column, key: Column) -> Column:
    """Groups in hexadecimal digits, either eight or with some left out; fewer than three are no address."""
    groups = F.filter(F.split(v, ":"), lambda g: g != "")
    small = F.lower(v) == v
    new = F.when(small, _string_feistel(key, "address6", v, _HEX)).otherwise(F.upper(_string_feistel(key, "address6", F.lower(v), _HEX)))
    return F.when(v.rlike("[0-9]") & (F.size(groups) >= 3), new)


def _small_iban(v: Column, key: Column) -> Column:
    return F.lower(_iban(F.upper(v), key))


def _secret(v: Column, key: Column) -> Column:
    name = F.regexp_extract(v, f"^{SECRET_NAME} ?[=:] ?[\"']?", 0)
    end = F.regexp_extract(v, "[\"']$", 0)
    value = F.substring(v, F.length(name) + 1, F.length(v) - F.length(name) - F.length(end))
    hexadecimal = value.rlike("^[0-9a-f]+$")
    return F.concat(name, F.when(hexadecimal, _string_feistel(key, "secret", value, _HEX)).otherwise(_string_feistel(key, "secret", value)), end)


def _iban(v: Column, key: Column) -> Column:
    plain = F.regexp_replace(v, " ", "")
    body = _string_feistel(key, "iban", F.substring(plain, F.lit(5), F.length(plain)))
    land = F.substring(plain, 1, 2)
    check = _padded(98 - _mod97(F.concat(land, F.lit("00"), body)), 2)
    whole = F.concat(land, check, body)
    # Back in the groups of the match.
    spaced = F.regexp_replace(whole, "(.{4})(?=.)", "$1 ")
    return F.when((F.length(plain) >= 15) & (_mod97(plain) == 1), F.when(v.contains(" "), spaced).otherwise(whole))


def _address(v: Column, key: Column) -> Column:
    parts = F.split(v, "\\.")
    octet = [parts[i].cast("bigint") for i in range(4)]
    valid = octet[0] <= 255
    for o in octet[1:]:
        valid = valid & (o <= 255)
    number = ((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3]
    new = _number_feistel(key, "address", number, 65536, 65536)
    shown = F.transform(
        F.array(F.lit(24), F.lit(16), F.lit(8), F.lit(0)),
        lambda s: F.floor(new / F.pow(F.lit(2), s)).cast("bigint").bitwiseAND(F.lit(255)).cast("string"),
    )
    # Addresses with leading zeros are other values than those without: left alone.
    return F.when(valid & ~v.rlike("(^|\\.)0[0-9]"), F.array_join(shown, "."))


def _date(v: Column, key: Column) -> Column:
    """Year first, or day first, or month first where the day cannot come first. Fields of one digit stay unpadded."""
    parts, mark = F.split(v, "[/.-]"), F.regexp_extract(v, "[/.-]", 0)
    first, second, third = (parts[i] for i in range(3))
    iso = F.length(first) == 4

    def day_of(year: Column, month: Column, day: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    day_first = day_of(third, second, first)
    day = F.when(iso, day_of(first, second, third)).otherwise(F.coalesce(day_first, day_of(third, first, second)))
    number = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("bigint")
    a, b = DAYS
    new = F.date_add(F.lit("1900-01-01").cast("date"), _number_feistel(key, "date", number, a, b).cast("int"))
    short = (F.length(second) == 1) | (F.length(F.when(iso, third).otherwise(first)) == 1)
    month, date = (F.when(short, F.date_format(new, one)).otherwise(F.date_format(new, one * 2)) for one in ("M", "d"))
    year = F.date_format(new, "yyyy")
    around = F.when(day_first.isNotNull(), F.concat(date, mark, month)).otherwise(F.concat(month, mark, date))
    shown = F.when(iso, F.concat(year, mark, month, mark, date)).otherwise(F.concat(around, mark, year))
    return F.when((number >= 0) & (number < a * b), shown)


def _social(v: Column, key: Column) -> Column:
    area, group, serial = (F.substring(v, s, n).cast("bigint") for s, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    place = area - 1 - (area > 666).cast("bigint")
    new = _number_feistel(key, "social", (place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999)
    head = F.floor(new / 9999).cast("bigint")
    place = F.floor(head / 99).cast("bigint")
    area = place + 1 + (place >= 665).cast("bigint")
    shown = F.concat_ws("-", _padded(area, 3), _padded(F.pmod(head, F.lit(99)) + 1, 2), _padded(F.pmod(new, F.lit(9999)) + 1, 4))
    # Taxpayers' numbers have areas from 900 on, and are permuted among themselves.
    digits = _padded(_number_feistel(key, "taxpayer", F.pmod(_only_digits(v).cast("bigint"), F.lit(10**8)), 10**4, 10**4), 8)
    taxpayer = F.concat(F.lit("9"), F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 4))
    return F.when(valid, shown).when(v.startswith("9") & (group >= 1) & (serial >= 1), taxpayer)


def _phone(v: Column, key: Column) -> Column:
    digits = _only_digits(v)
    plus = v.startswith("+")
    # North America: country code 1 or none. Areas and exchanges are 200 to 999; numbers without these are
    # as many as 60,000 x 60,000 and are permuted among themselves, so that the others stay valid.
    local = F.substring(digits, -10, 10)
    head = F.substring(digits, F.lit(1), F.length(digits) - 10)
    american = ((F.length(digits) == 10) & ~plus) | ((F.length(digits) == 11) & (head == "1"))
    area, exchange, line = (F.substring(local, s, n).cast("bigint") for s, n in ((1, 3), (4, 3), (7, 4)))
    new = _number_feistel(key, "phone", ((area - 200) * 800 + exchange - 200) * 10_000 + line, 80_000, 80_000)
    upper = F.floor(new / 10_000).cast("bigint")
    valid = F.concat(_padded(F.floor(upper / 800).cast("bigint") + 200, 3), _padded(F.pmod(upper, F.lit(800)) + 200, 3), _padded(F.pmod(new, F.lit(10_000)), 4))
    # First all numbers of areas below 200, then those of other areas with exchanges below 200.
    low = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
    new = _number_feistel(key, "phone low", low * 10_000 + line, 60_000, 60_000)
    upper = F.floor(new / 10_000).cast("bigint")
    rest = upper - 200_000
    upper = F.when(rest < 0, upper).otherwise((F.floor(rest / 200).cast("bigint") + 200) * 1000 + F.pmod(rest, F.lit(200)))
    other = F.concat(_padded(upper, 6), _padded(F.pmod(new, F.lit(10_000)), 4))
    shown = F.concat(head, F.when(local.rlike("^[2-9][0-9]{2}[2-9]"), valid).otherwise(other))
    # Elsewhere: the first two digits stay, the others are permuted.
    abroad = F.concat(F.substring(digits, 1, 2), _string_feistel(key, "phone", F.substring(digits, F.lit(3), F.length(digits))))
    foreign = plus & F.length(digits).between(8, 15)
    # Within a country the 0 stays. Three groups as in North America are taken for one of its numbers.
    inland = F.concat(F.lit("0"), _string_feistel(key, "inland", F.substring(digits, F.lit(2), F.length(digits))))
    national = v.rlike(f"^(?:{NATIONAL})$") & ~v.rlike(f"^(?:{AMERICAN}|{SOCIAL})$")
    return (
        F.when(national, F.when(F.length(digits).between(9, 12), _filled(v, inland)))
        .when(american, _filled(v, shown))
        .when(foreign, _filled(v, abroad))
    )


def _card(v: Column, key: Column) -> Column:
    digits = _only_digits(v)
    body = _string_feistel(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    rest = _luhn_sum(F.concat(body, F.lit("0")))
    check = F.pmod(-rest, F.lit(10)).cast("string")
    return F.when(F.length(digits).between(13, 19) & (F.pmod(_luhn_sum(digits), F.lit(10)) == 0), _filled(v, F.concat(body, check)))


_RULES = {
    "mail": _mail, "key": _cloud_key, "token": _token, "secret": _secret, "iban": _iban, "small iban": _small_iban, "address": _address,
    "address6": _address6, "date": _date, "social": _social, "named social": _named_social, "phone": _phone, "card": _card,
}


def valued(match: Column) -> Column:
    """Where in the match its value stands, as (lead, value): a card behind short groups, or the longest valid
    part of a card or account number that ends at a separator; else all of the match."""
    cards = F.array(*(F.regexp_extract(match, rf"^[0-9](?:[ \-]?[0-9]){{{n - 1}}}(?=[ \-])", 0) for n in range(18, 12, -1)))
    groups = F.split(match, " ")
    ibans = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, 1, n), " "))

    def card_holds(v: Column) -> Column:
        return (v != "") & (F.pmod(_luhn_sum(_only_digits(v)), F.lit(10)) == 0)

    def iban_holds(v: Column) -> Column:
        plain = F.regexp_replace(F.upper(v), " ", "")
        return v.rlike(f"^(?:{IBAN}|{SMALL_IBAN})$") & (F.length(plain) >= 15) & (_mod97(plain) == 1)

    def part(lead: Column, value: Column) -> Column:
        return F.struct(lead.alias("lead"), value.alias("value"))

    lead = F.regexp_extract(match, f"^{LEAD}(?=[0-9]{{4}})", 0)
    led = F.substring(match, F.length(lead) + 1, F.length(match))
    is_led = match.rlike(f"^(?:{LED_CARD})$") & card_holds(led)
    shorter = F.when(match.rlike(f"^(?:{CARD})$") & ~card_holds(match), F.get(F.filter(cards, card_holds), F.lit(0)))
    in_card = F.when(is_led, part(lead, led)).when(shorter.isNotNull(), part(F.lit(""), shorter))
    in_iban = F.when(match.rlike(f"^(?:{IBAN}|{SMALL_IBAN})$"), F.get(F.filter(ibans, iban_holds), F.lit(0)))
    return F.coalesce(in_card, F.when(in_iban.isNotNull(), part(F.lit(""), in_iban)), part(F.lit(""), match))


def pseudonym(match: Column, key: Column) -> Column:
    """The pseudonym of one match: of the first kind that it is valid of, else the match itself."""
    return F.coalesce(*(F.when(match.rlike(f"^(?:{_KINDS[name]})$"), rule(match, key)) for name, rule in _RULES.items()), match)


def pseudonymize(docs: DataFrame, key: str, text: str = "text", counted: str | None = None) -> DataFrame:
    """`docs` with the personal data in `text` replaced by pseudonyms of the same format; `counted` names a
    column for the number of replaced matches.

    Mail addresses keep their domain, keys their first four letters, foreign phone numbers their first two
    digits. What looks like a number of some kind but fails its check (a card's check digit, an octet over
    255, a day that no month has) stays as it is. Null stays null, empty stays empty, all other columns and
    all rows stay; nothing is shuffled. Whole texts are read, however
    long.
    """
    value = F.col(text)
    found, new = unused(docs, "_matches"), unused(docs, "_pseudonyms")
    held = docs.withColumn(found, F.regexp_extract_all(value, F.lit(PATTERN), F.lit(0)))
    some = F.size(found) > 0
    # What stands beside the value stays.
    def put(m: Column, v: Column) -> Column:
        behind = F.substring(m, F.length(v["lead"]) + F.length(v["value"]) + 1, F.length(m))
        return F.concat(v["lead"], pseudonym(v["value"], F.lit(key)), behind)

    made = F.zip_with(found, F.transform(found, valued), put)
    held = held.withColumn(new, F.when(some, made))
    # What lies between the matches, and the pseudonyms, in turns.
    pieces = F.zip_with(F.split(value, PATTERN, -1), new, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    out = held.withColumn(text, F.when(some, F.array_join(pieces, "")).otherwise(value))
    if counted:
        changed = F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)
        out = out.withColumn(counted, F.when(some, F.size(changed)).otherwise(0))
    return out.drop(found, new)
