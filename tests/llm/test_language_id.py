import zlib
from collections import Counter

import numpy as np

from barograph.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, lang_pred int, n long"


def grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = f" {word} "
        out.update(g for n in (1, 2, 3) for i in range(len(w) - n + 1) if (g := w[i : i + n]).strip())
    # a blank before a word and one after the word before it are the same place
    return {tuple(map(ord, g)): n for g, n in out.items()}


def code(g):
    out = 0
    for c in g:
        out = out << 21 | c
    return out


def test_grams_are_those_of_padded_words(monkeypatch):
    for text in ("", "Ab 1 ab!", "ÉÉ été, l'été — 東京 x", "z" * 50, "a b " * 30):
        codes, counts = L.gram_counts(text)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in grams(text).items()}
    whole = L.gram_counts("le été de la mer, und so weiter " * 40)
    monkeypatch.setattr(L, "BLOCK", 7)
    cut = L.gram_counts("le été de la mer, und so weiter " * 40)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op1_language_id(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_predictions_read_the_text_only(spark):
    train = [(i, t, x, None, None) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 5)]
    profiles = L.learn(spark.createDataFrame(train, SCHEMA))
    assert sorted(profiles) == ["en", "fr"]
    rows = [(1, "the dog", "fr", 5, 1), (1, "the dog", "fr", 5, 1), (None, "le chien", None, None, None), (3, None, "en", 1, 1), (4, "", "en", 1, 1), (5, "123 !?", "en", 1, 1), (6, "the " * 300_000, None, 0, 0)]
    got = L.identify(spark.createDataFrame(rows, SCHEMA), profiles)
    assert got.columns == ["doc_id", "text", "lang", "n", "lang_pred", "score"]
    assert [(r.doc_id, r.lang_pred) for r in got.select("doc_id", "lang_pred").collect()] == [(1, "en"), (1, "en"), (None, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en")]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.learn(empty) == {} and L.identify(empty, {}).count() == 0
    one = spark.createDataFrame([(1, "some text", None, None, None), (2, None, "en", None, None)], SCHEMA)
    assert L.learn(one) == {} and {r.lang_pred for r in L.identify(one, {}).collect()} == {"und"}
    assert L.reject_unknown(one).count() == 0
    assert [(p, r) for p, r in [L.Judge({"b": np.array([97]), "a": np.array([97])}, 300).judge("a")]][0][0] == "a"


def test_every_label_is_learned(spark):
    names = [f"l{k:03}" for k in range(520)]
    word = lambda k: "".join(chr(ord("a") + int(d)) for d in f"{k:03}") * 3
    rows = [(k, word(k), x, None, None) for k, x in enumerate(names)] + [(1000 + k, word(k), names[k], None, None) for k in range(500)]
    profiles = L.learn(spark.createDataFrame(rows, SCHEMA))
    assert sorted(profiles) == names
    assert L.Judge(profiles, 300).judge(word(519)) == ("l519", 1.0)


def test_judge_is_its_definition():
    draw = np.random.default_rng(1)
    profiles = {x: draw.permutation(400)[:n] + 97 for x, n in (("b", 300), ("a", 300), ("c", 7))}
    text = "".join(chr(97 + int(i)) for i in draw.integers(0, 400, 900))
    top = L.ranked(*L.gram_counts(text), 300).tolist()
    far = {x: sum(min(300, abs(p.tolist().index(g) - k)) if g in p else 300 for k, g in enumerate(top)) for x, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    assert L.Judge(profiles, 300).judge(text) == (best, 1.0 - far[best] / (300 * len(top)))


def test_texts_like_no_profile_are_rejected(spark):
    rows = [(i, t, x, None, None) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    odd = [(100, "東京都は日本の首都", None, None, None), (101, "Привет, мир", None, None, None), (102, "the dog", None, None, None), (103, "1 2", None, None, None)]
    got = {r.doc_id for r in L.reject_unknown(spark.createDataFrame(rows + odd, SCHEMA)).collect()}
    assert got == {*range(40), 102}
