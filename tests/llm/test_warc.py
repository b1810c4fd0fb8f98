import hashlib

import pytest

from llm.common import shared_folder
from llm.warc import archive_round_trip, read_archives, write_archives
from tests.llm.helpers import CLASHING, table

BIG = "<p>" + "payload é \r\n\r\n WARC/1.1\r\n" * 12
ROWS = [
    (5, "http://a.example/1", BIG),
    (3, "http://a.example/2", BIG),
    (9, None, BIG),
    (1, "http://a.example/\x01 3", "short"),
    (2, "http://a.example/4", "short"),
    (4, "http://a.example/5", None),
    (6, "http://a.example/6", ""),
    (7, "http://a.example/7", "x" * 99),
    (8, "http://a.example/8", "x" * 99),
    (10, "http://a.example/9", "é" * 50),
    (11, "http://a.example/9", "é" * 50),
    (12, "http://a.example/9", "y" * 300_000),
    (None, "http://a.example/9", "y" * 300_000),
    (13, "http://a.example/13", "z" * 200),
    (13, "http://a.example/13", "z" * 200),
]
SCHEMA = "page_id bigint, url string, html string"


def plain(rows):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        first = min((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        back = len(payload) >= 100 and i != first
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if back else "response", first if back else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clashing", [False, True])
def test_round_trip_of_awkward_rows(spark, clashing):
    pages = table(spark, ROWS, SCHEMA)
    if clashing:
        pages = pages.selectExpr("*", *[f"'x' AS `{c}`" for c in [*CLASHING, "digest", "payload", "value"]])
    got = archive_round_trip(pages, shared_folder(spark, "warc"))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(ROWS)


def test_archives_hold_each_long_payload_once(spark):
    folder = shared_folder(spark, "warc")
    write_archives(table(spark, ROWS[:9], SCHEMA), folder)
    records = read_archives(spark, folder, with_payload=True).collect()
    assert sum(r["payload"] == BIG.encode() for r in records) == 1 and sum(r["type"] == "revisit" for r in records) == 2
    assert len({r["record_id"] for r in records}) == 9
    assert {r["uri"] for r in records if r["row_id"] in (1, 9)} == {"http://a.example/3", "urn:page:9"}


def test_empty_table(spark):
    assert archive_round_trip(table(spark, [], SCHEMA), shared_folder(spark, "warc")).count() == 0
