import hashlib
import random

import numpy as np

from barograph.llm import order_minhash as O


def brute_numbers(text, k):
    seen, out = {}, []
    for i in range(max(1, len(text) - k + 1)):
        g = text[i : i + k]
        out.append((g, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    return out


def test_occurrences_are_numbered():
    omh = O.OrderMinHash(k=3)
    for text in ("abcabcabc", "aaaaaaa", "ab", "x", "éàé" * 40):
        want, got = brute_numbers(text, 3), omh.numbered(text).tolist()
        assert len(got) == len(want) and all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(got)) for j in range(i))
        again = omh.numbered("zz" + text)[2:] if len(text) >= 3 else None
        assert again is None or again.tolist() == got  # the same k-mers elsewhere hash alike


def test_sketch_is_its_definition(monkeypatch):
    omh = O.OrderMinHash(k=4, ell=3, m=16)
    text = "the quick brown fox jumps over the lazy dog and the quick cat " * 3

    def chosen(text):
        """For each function the numbered k-mers of the smallest hashes, in text order."""
        low, named = (omh.numbered(text) >> np.uint64(32)).astype(np.uint32), brute_numbers(text, 4)
        out = []
        for flip, times in zip(omh.flip, omh.times, strict=True):
            h = (low ^ flip) * times
            out.append(tuple(named[i] for i in sorted(sorted(range(len(h)), key=lambda i: (h[i], i))[:3])))
        return out

    each = omh.numbered(text)
    assert omh.sketch(text).tolist() == omh.components(each, [omh.smallest(each, 0, 50), omh.smallest(each, 50, len(each))]).tolist()
    for other in (text[:-1] + "x", text[20:] + text[:20], text[:90] + "another end of the story", text[::-1]):
        want = [a == b for a, b in zip(chosen(text), chosen(other), strict=True)]
        assert (omh.sketch(text) == omh.sketch(other)).tolist() == want and O.likeness(omh.sketch(text), omh.sketch(other)) == np.mean(want)
    monkeypatch.setattr(O, "BLOCK", 16)
    assert omh.sketch(text).tolist() == O.OrderMinHash(k=4, ell=3, m=16).sketch(text).tolist()


def test_likeness_follows_edits_and_order():
    omh, draw = O.OrderMinHash(m=256), random.Random(1)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    base = " ".join(words)
    near = [O.likeness(omh.sketch(base), omh.sketch(" ".join(w if draw.random() > p else "edit" + str(i) for i, w in enumerate(words)))) for p in (0.0, 0.02, 0.1, 0.5)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[3] < 0.4
    mixed = words[:]
    draw.shuffle(mixed)
    assert O.likeness(omh.sketch(base), omh.sketch(" ".join(mixed))) < 0.6  # the same words in another order


def brute_query(rows):
    omh, rows = O.OrderMinHash(), sorted(rows, key=lambda r: r[0])
    out = {}
    for k, (i, text) in enumerate(rows):
        a, b = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        s, e = omh.sketch(a), omh.sketch(edited)
        out[i] = (len(a), hashlib.sha256(edited.encode()).hexdigest(), O.written(s), O.written(e), O.likeness(s, e), O.likeness(s, omh.sketch(b)))
    return out


def run(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
    return {r.doc_id: tuple(r)[1:] for r in O.op4_order_minhash(spark, str(tmp_path / name)).collect()}


def test_query_is_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in O.op4_order_minhash(spark, sf).collect()} == brute_query(rows)


def test_edge_cases(spark, tmp_path):
    rows = [(5, None), (2, ""), (9, "ab"), (11, "long " * 60_000), (40, "same text"), (41, "same text"), (-3, "é" * 9)]
    got = run(spark, tmp_path, rows, "a")
    assert got == brute_query(rows) and got[40][2] == got[41][2] and got[5][2] == ""
    assert run(spark, tmp_path, [(1, "alone here")], "b") == brute_query([(1, "alone here")])
    assert run(spark, tmp_path, [], "c") == {}
    tied = run(spark, tmp_path, [(None, "no id"), (1, "x y z"), (1, "x y z")], "d")
    assert set(tied) == {None, 1} and O.fingerprints(spark.createDataFrame([(1, None, 3)], "a long, text string, fingerprint int")).first().fingerprint == ""


def test_half_a_text_is_seen_within_the_stated_error():
    omh, draw = O.OrderMinHash(), random.Random(3)
    text = lambda n: "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(n))
    near = []
    for _ in range(60):
        half = text(200)
        near.append(O.likeness(omh.sketch(half + text(200)), omh.sketch(half + text(200))))
    # both smallest k-mers must lie in the common half, which is a third of all k-mers of the two texts
    error = (1 / 9 * 8 / 9 / omh.m) ** 0.5
    assert 0.5 / omh.m**0.5 <= 0.032 and min(near) > 0
    assert abs(np.mean(near) - 1 / 9) < 0.03 and np.std(near) < 2 * error
