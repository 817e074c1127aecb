import hashlib

import pytest

from barograph.llm.passage_dedup import dedup_passages, op9_passage_dedup

SCHEMA = "doc_id long, text string, th int, start string"


def brute(rows, size):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        keep = [True] * len(words)
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            if w in seen:
                keep[k : k + size] = [False] * size
            seen.add(w)
        out[i] = (len(words), keep.count(False), hashlib.sha256(b" ".join(w for w, x in zip(words, keep, strict=True) if x)).hexdigest())
    return out


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op9_passage_dedup(spark, sf).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows, 20)
    assert sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize("size, shard_chars, bits", [(20, 500, 1 << 20), (12, 10**6, 1 << 15)])
def test_small_shards_and_full_filters_change_nothing(spark, size, shard_chars, bits):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), size=size, shard_chars=shard_chars, filter_bits=bits).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got} == brute(rows, size)


def test_long_passages_and_wide_gaps(spark):
    w = [f"w{i}" for i in range(9000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:4100] + ["x"] + w[4100:])), (3, " ".join(w[1990:2030] + ["y"] * 30 + w[5000:5019] + ["z"] + w[5019:5060])), (4, " ".join(w[::-1])), (5, "w1 " * 5000)]
    got = dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), shard_chars=4000).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got} == brute(rows, 20)


def test_edge_cases(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(4, f"{a} mid {b}"), (2, a), (9, f"x {b} y\n{b}\t z"), (5, None), (6, ""), (7, "w " * 100), (8, " \t\n"), (10, a.upper()), (11, f"{a[:100]} {b[40:]}"), (12, "v " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in dedup_passages(docs).collect()}
    assert got == brute(rows, 20)
    assert dedup_passages(docs).columns == [*docs.columns, "n_words", "n_removed"]
    assert dedup_passages(docs.limit(0)).count() == 0
    rows = [(0, b), (1, a), (1, b), (2, a), (2, f"{a} c")]
    got = dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(0, 60, 0), (1, 60, 0), (1, 60, 60), (2, 60, 60), (2, 61, 60)]
    twice = spark.createDataFrame([(None, a, 1, "s"), (1, a, 1, "s"), (1, a, 1, "s")], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_removed) for r in dedup_passages(twice).collect()) == [(0, 0), (1, 60), (1, 60)]
