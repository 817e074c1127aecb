import hashlib
import re
from collections import Counter

import pytest

from barograph.llm.line_dedup import dedup_lines, op8_line_dedup


def brute(rows, least=10, chars=1):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < least]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_query_is_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in op8_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    assert got == brute(rows) and any(v[1] for v in got.values())


@pytest.mark.parametrize("chars", [1, 5])
def test_edge_cases(spark, chars):
    rows = [(1, "Boiler\n a \n\nB"), (2, "\x0bBOILER\t\nx\r"), (3, "boiler\nboiler\n"), (4, None), (5, ""), (6, "\n\n"), (7, "ÉTÉ\nété"), (8, "line\n" * 50_000 + "boiler"), (None, "boiler\nkeep\u00a0")]
    docs = spark.createDataFrame([(i, t, 1, "l", 3) for i, t in rows], "doc_id long, text string, n_lines int, source string, pos int")
    got = dedup_lines(docs, 3, chars)
    assert got.columns == ["doc_id", "text", "source", "pos", "n_lines", "n_dropped"]
    assert {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()} == brute(rows, 3, chars)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_repeated_rows_are_one_document_and_all_stay(spark):
    docs = spark.createDataFrame([(1, "a\nb")] * 3 + [(1, "a\nc"), (2, "a\nd")], "doc_id long, text string")
    assert sorted(r.text for r in dedup_lines(docs, 3).collect()) == ["a\nb", "a\nb", "a\nb", "a\nc", "a\nd"]
    assert sorted(r.text for r in dedup_lines(docs, 2).collect()) == ["b", "b", "b", "c", "d"]


def test_rows_of_one_document_count_once(spark):
    rows = [(1, "a\nb")] * 10 + [(None, "c\nd")] * 12 + [(k, "e\nf") for k in range(2, 12)] + [(k, "g") for k in range(2, 11)] + [(3, "g")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()
    assert len(got) == len(rows)
    assert all(r.n_dropped == (2 if r.doc_id and r.doc_id > 1 and r.n_lines == 2 else 0) for r in got)  # e and f only
