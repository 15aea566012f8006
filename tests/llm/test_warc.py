import base64
import hashlib
import random

import numpy as np
import pytest

from tonescope.llm import warc
from tonescope.llm.common import new_path

PAGES = "page_id long, url string, html string"


def expected(rows):
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and first[h or ""] != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"


def rows_of(n=60):
    r = random.Random(3)
    rows = [(i, f"http://x/{i}", "".join(r.choices("ab <>é\r\n", k=r.randint(0, 300)))) for i in range(n)]
    rows += [(n, None, None), (n + 1, "u", ""), (n + 2, "a\r\nX: y", "same"), (n + 3, "b", "same"), (n + 4, "c", FAKE), (n + 5, "d", "x" + FAKE * 3 + "WARC/1.1\r\n"), (n + 6, "e", "\r\n\r\n" + FAKE), (n + 7, "f", "WARC/1.1\r\n"), (n + 8, "g", FAKE), (n + 9, "h", "\r\n" * 9), (n + 10, "i", "z" * 200_000)]
    return rows


@pytest.mark.parametrize("split", [None, "700", "64"])
def test_round_trip(spark, split):
    """Also with files in splits that are far shorter than records, and with false records in payloads."""
    rows = rows_of()
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        path = new_path(spark, "warc-test")
        if split == "64":
            rows = [x for x in rows if len(x[2] or "") < 400]
        warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(2), path)
        if split:
            spark.conf.set(key, split)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = warc.candidates(spark, path)
        if split:
            assert found.select("block").distinct().count() > 10
        got = warc.read_warc(spark, path)
        out = [(int(g["id"][12:-1]), g["payload_bytes"], g["digest"], g["type"], int(g["refers_to"][12:-1]) if g["refers_to"] else None) for g in got.collect()]
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(out, key=str) == expected(rows)


def test_query_form_and_edges(spark):
    rows = rows_of(5)
    got = [tuple(r) for r in warc.warc_round_trip(spark.createDataFrame(rows, PAGES)).collect()]
    assert sorted(got, key=str) == expected(rows)
    assert warc.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0
    odd = spark.createDataFrame([(None, "u", "t"), (1, "u", "t"), (1, "u", "t"), (2, "u", "t")], PAGES)
    got = sorted((tuple(r)[::3] + (r["refers_to"],) for r in warc.warc_round_trip(odd).collect()), key=str)
    assert got == sorted([(None, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)], key=str)


def test_small_payloads_may_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    got = {r["page_id"]: r["record_type"] for r in warc.warc_round_trip(df, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_files_are_valid_archives(spark, tmp_path):
    warc.write_warc(spark.createDataFrame(rows_of(3), PAGES).coalesce(1), str(tmp_path / "w"))
    data, at, n = next((tmp_path / "w").glob("*.txt")).read_bytes(), 0, 0
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length"))[16:])
        assert rest[size : size + 4] == b"\r\n\r\n"
        at += len(head) + 4 + size + 4
        n += 1
    assert n == len(rows_of(3))


def test_broken_chain_is_told(spark, tmp_path):
    warc.write_warc(spark.createDataFrame(rows_of(9), PAGES).coalesce(1), str(tmp_path / "w"))
    file = next((tmp_path / "w").glob("*.txt"))
    data = file.read_bytes()
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    file.write_bytes(data[: len(data) // 2])
    with pytest.raises(ValueError, match="breaks off"):
        warc.read_warc(spark, str(tmp_path / "w"))


def test_pointer_jumping():
    offset = np.array([0, 5, 10, 12, 30])
    successor = np.array([10, 7, 30, 30, 50])
    assert warc.jump_inside(offset, successor).tolist() == [50, -1, 50, 50, 50]
    assert warc.reached_inside(offset, successor, 0).tolist() == [True, False, True, False, True]
    assert warc.reached_inside(offset, successor, 3).any() == False  # noqa: E712
