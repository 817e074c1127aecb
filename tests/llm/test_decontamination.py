import re

from barograph.llm.decontamination import candidates, contaminated, drop_contaminated, item_index, minima_of, op2_decontamination

ITEM = " ".join(f"q{i}" for i in range(30))
LONG = " ".join(f"z{i}" for i in range(20_000))


def brute(docs, items, percent=80):
    def grams(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    split = lambda t: re.findall(r"\w+", (t or "").lower())
    out, by_width = set(), {}
    for d, text in docs:
        w = split(text)
        for i, t in items:
            q = split(t)
            n = min(5, len(q))
            if n:
                key = (d, n)
                if key not in by_width:
                    by_width = {k: v for k, v in by_width.items() if k[0] == d}
                    by_width[key] = grams(w, n)
                s = grams(q, n)
                if 100 * len(s & by_width[key]) >= percent * len(s):
                    out.add((d, i, len(s), len(s & by_width[key])))
    return out


def test_same_as_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in op2_decontamination(spark, sf).collect()}
    assert got == brute(docs, items) and got


def test_an_item_cannot_lack_all_its_minima():
    for n in range(1, 500):
        assert minima_of(n, 80) > n - -(-80 * n // 100) or minima_of(n, 80) == n


def test_edge_cases(spark):
    items = spark.createDataFrame([(1, ITEM), (2, ITEM.upper()), (3, None), (4, ""), (5, "two words"), (6, "...")], "item_id long, text string")
    rows = [(1, f"{LONG} {ITEM}, {LONG}"), (2, LONG), (3, None), (4, ""), (5, "just Two, words here"), (None, ITEM), (7, ITEM), (7, ITEM), (8, ITEM.replace("q15", "x")), (9, ITEM[: len(ITEM) // 2])]
    docs = spark.createDataFrame([(i, t, 1.0, "h") for i, t in rows], "doc_id long, text string, n double, hash string")
    got = sorted(((r.id or 0, r.item_id, r.copies) for r in contaminated(docs, items).collect()))
    assert got == [(0, 1, 2), (1, 1, 2), (5, 5, 1), (7, 1, 2), (8, 1, 2)]
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 9]
    assert drop_contaminated(docs, items.limit(0)).count() == len(rows) and contaminated(docs.limit(0), items).count() == 0


def test_only_pairs_with_a_minimum_are_candidates(spark):
    phrase = "a phrase that all of these items have"
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(40)) + " " + phrase) for i in range(30)], "item_id long, text string")
    index = item_index(items, 5, 80, "item_id", "text").cache()
    rows = index.collect()
    # a document of the phrase only has shingles of every item, but minima of some
    common = {r.hash for r in rows if sum(x.hash == r.hash for x in rows) == 30}
    hits = spark.createDataFrame([(1, 7, h) for h in common], "id long, text_hash long, hash long")
    want = {r.item_id for r in rows if r.minimum and r.hash in common}
    assert {(r.id, r.item_id) for r in candidates(hits, index).collect()} == {(1, i) for i in want} and len(common) == 4 and len(want) < 30
    docs = spark.createDataFrame([(1, phrase), (None, items.first().text)], "doc_id long, text string")
    assert [(r.id, r.item_id, r.shared) for r in contaminated(docs, items).collect()] == [(None, 0, 44)]
