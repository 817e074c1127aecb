from collections import Counter

import pytest

from barograph.llm.components import connected_components
from barograph.llm.minhash_dedup import NearDup, drop_near_duplicates, near_duplicates, op7_minhash_dedup

A = " ".join(f"w{i}" for i in range(60))
B = A.replace("w59", "other")
SCHEMA = "doc_id long, text string, component_id int, id string"


def brute(rows, words, percent):
    def shingle_set(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in sorted(sets.items()):
        for j, n in Counter(j for x in s for j in index[x]).items():
            if j < i and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_same_groups_as_brute_force(spark, words, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], words, percent)
    got = near_duplicates(docs, NearDup(words=words, percent=percent)).collect()
    assert len(got) == len(want)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(want)


def test_query(spark, sf):
    assert op7_minhash_dedup(spark, sf).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_edge_cases(spark):
    rows = [(5, A), (3, B), (3, B), (None, A), (7, None), (8, ""), (9, " \t\n"), (10, "one two"), (11, "ONE two"), (12, "x " * 50_000), (13, "x " * 60_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got[5, 56] == (3, False) and got[3, 56] == (3, True) and got[None, 56] == (None, True)
    assert got[7, 0] == (7, True) and got[8, 0] == (8, True) and got[9, 0] == (9, True)
    assert got[10, 1] == (10, True) and got[11, 1] == (10, False)
    assert got[12, 1] == (12, True) and got[13, 1] == (12, False)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 3, 7, 8, 9, 10, 12]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain_is_one_component(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 501), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}


def test_ids_of_any_type_and_texts_that_share_an_id(spark):
    rows = [("b", A), ("a", B), ("c", None), ("d", "one two"), ("a", "one two"), ("e", A[::-1])]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == [("a", 1, "a", True), ("a", 56, "a", True), ("b", 56, "a", False), ("c", 0, "c", True), ("d", 1, "a", False), ("e", 56, "e", True)]
    other = A[::-1]
    docs = spark.createDataFrame([(1, A), (2, A), (2, other), (3, other + " more")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()) == [(1, A), (2, other)]
