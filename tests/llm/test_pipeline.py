import re
from collections import Counter

import corpus_pipeline as cp
from barograph.llm.language_id import UNKNOWN, identify, learn, training_fold
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_minhash_dedup import brute as groups
from tests.llm.test_packing import check_places


def test_stages_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == cp.COLUMNS, name


def test_same_as_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    said = identify(docs, learn(training_fold(docs))).collect()
    assert {r.doc_id for r in said if r.lang_pred == UNKNOWN} == {i for i, t in rows.items() if not t or not any(c.isalpha() for c in t)}
    rows = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}

    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
    held = Counter(k for t in rows.values() for k in {key(x) for x in t.split("\n")} if k)
    rows = {i: "\n".join(x for x in t.split("\n") if held[key(x)] < 10) for i, t in rows.items()}
    found = groups(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if found[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, *_ in leaks(list(rows.items()), items)}
    want = set(rows) - bad
    got = cp.run(spark, sf).collect()
    assert {r.doc_id for r in got} == want and bad
    tokens = sum(r.length for r in got)
    assert check_places([r.asDict() for r in got], 2048) <= 1.03 * -(-tokens // 2048) + 1
    ends = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert (r.start, r.piece) == ends.get(r.doc_id, (0, 0))
        ends[r.doc_id] = (r.start + r.length, r.piece + 1)


def test_odd_rows_and_empty_tables(spark, sf, tmp_path):
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*cp.COLUMNS).limit(60).collect()]
    long = " ".join(f"word{i}" for i in range(30_000))
    item = " ".join(f"q{i}" for i in range(30))
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \n\t", None, "s", 3), (9004, long, "en", "s", 1), (9004, long, "en", "s", 1), (9005, long, "fr", None, 1), (None, "a text of a few words and no id", None, None, None), (9006, f"{long} {item}", "en", "s", 1), (9007, "12345 67890", "en", "s", 11)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame(real + odd, schema).selectExpr("*", "1 as th", "'x' as length", "map('k', 2) as set")
    for name, docs in (("some", rows), ("none", rows.limit(0))):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = cp.run(spark, d).collect()
        if name == "none":
            assert got == []
            continue
        kept = {r.doc_id for r in got}
        assert kept.isdisjoint({9001, 9002, 9003, 9005, 9006, 9007}) and {9004, None} <= kept
        pieces = {}
        for r in got:
            pieces.setdefault((r.doc_id, r.piece), []).append((r.start, r.length))
        assert sorted(k for k in pieces if k[0] == 9004) == [(9004, k) for k in range(len([k for k in pieces if k[0] == 9004]))]
        assert all(len(v) == (2 if k[0] == 9004 else 1) for k, v in pieces.items())  # a repeated row is two documents
        check_places([r.asDict() for r in got], 2048)
