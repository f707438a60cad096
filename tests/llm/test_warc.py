"""Archives written, read back, and damaged."""

import hashlib
import io
import zlib

import pytest

from faultline.llm import warc
from faultline.llm.common import folder_for


def round_trip(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int")
    files = warc.write_archives(df, folder_for(spark, "t"))
    return warc.read_archives(files).collect()


def test_copies_small_pages_and_odd_rows(spark):
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [
        (1, "http://a/1", big, 0), (5, "http://a/5", big, 0), (3, None, big, 0), (2, "http://b/\r\nX: 1", other, 0),
        (4, "u", "x" * 999, 0), (6, "u", "x" * 999, 0), (7, "u", None, 0), (8, "u", "", 0), (None, "n", big, 0), (9, "u", "\r\n\r\n" * 300, 0),
    ]
    got = {r.record_id: r for r in round_trip(spark, rows)}
    assert len(got) == len(rows)
    for i, url, html, _ in rows:
        r, payload = got[f"urn:page:{'none' if i is None else i}"], (html or "").encode()
        revisit = html == big and i != 5
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == ("urn:page:5" if revisit else None)
        assert r.payload == (None if revisit else payload)
    assert got["urn:page:2"].target_uri == "http://b/%0D%0AX: 1" and got["urn:page:3"].target_uri is None


def test_repeated_rows_of_the_largest_id_stay_responses(spark):
    got = round_trip(spark, [(1, "u", "y" * 2000, 0), (2, "u", "y" * 2000, 0), (2, "u", "y" * 2000, 0)])
    assert sorted((r.record_id, r.record_type) for r in got) == [("urn:page:1", "revisit"), ("urn:page:2", "response"), ("urn:page:2", "response")]


def test_empty_table(spark):
    assert round_trip(spark, []) == []


def archive(payload=b"z" * 5000):
    one = warc.page_record(1, "u", payload, len(payload), hashlib.sha1(payload).hexdigest(), None, "2020-01-01T00:00:00Z")
    return one, one + one


class Drip(io.BytesIO):
    def read(self, n=-1):
        return super().read(min(n, 7))


def test_a_member_per_record_however_the_bytes_arrive():
    one, two = archive()
    found = list(warc.records(Drip(two)))
    assert [r.offset for r in found] == [0, len(one)] and found[0].http()[1] == b"z" * 5000
    assert zlib.decompress(one, 31).startswith(b"WARC/1.1\r\n")


@pytest.mark.parametrize("damage", ["cut", "digest", "length", "two", "no"])
def test_damage_is_found(damage):
    one, two = archive()
    plain = zlib.decompress(one, 31)
    pack = lambda b: (c := zlib.compressobj(wbits=31)).compress(b) + c.flush()
    data = {
        "cut": two[:-10],
        "digest": pack(plain.replace(b"zzzz", b"zzzy", 1)),
        "length": pack(plain.replace(b"z", b"", 1)),
        "two": pack(plain + plain),
        "no": b"no archive at all",
    }[damage]
    with pytest.raises(warc.BadArchive):
        list(warc.records(io.BytesIO(data)))
