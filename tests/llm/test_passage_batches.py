import numpy as np
import pyarrow as pa

from barograph.llm.common import text_hashes
from barograph.llm.passage_dedup import Shard


def test_segments_are_matched_at_once():
    a, b, c = ([f"{k}{i}é" for i in range(50)] for k in "abc")
    known = [(1, 0, 0, a), (2, 0, 5, b), (3, 0, 0, ["z"] * 30)]
    shard = Shard(pa.table({k: [x[i] if i < 3 else " ".join(x[3]) for x in known] for i, k in enumerate(("doc", "th", "start", "text"))}), 20)
    # a passage's own place, one that ends a segment and one that begins the next, and two halves that meet at a segment's end
    texts = [a, ["x"] + b[:25], b[25:] + ["y"], c[:15] + a[:10], a[10:21] + c, ["z"] * 25, ["q", *a[5:30], "q", *a[28:48]]]
    doc, start = np.array([1, 9, 9, 8, 8, 3, 7]), np.array([0, 4, 40, 0, 90, 2, 11])
    all_at_once = sorted(shard.occurrences(doc, np.zeros(7, int), start, [" ".join(t) for t in texts]))
    alone = sorted((k, s, n) for k, t in enumerate(texts) for _, s, n in shard.occurrences(doc[k : k + 1], np.zeros(1, int), start[k : k + 1], [" ".join(t)]))
    covered = lambda spots: {(k, s + x) for k, s, n in spots for x in range(n)}
    assert all_at_once == alone and covered(alone) == {(1, 5 + x) for x in range(25)} | {(2, 40 + x) for x in range(25)} | {(5, 2 + x) for x in range(25)} | {(6, 12 + x) for x in range(25)} | {(6, 38 + x) for x in range(20)}


def test_an_automaton_has_no_more_nodes_than_its_passages_have_words():
    texts = [" ".join(f"word{(k * 977 + i * i) % 9973}" for i in range(200)) for k in range(50)]
    zeros = np.zeros(50, int)
    shard = Shard(pa.table({"doc": np.arange(50), "th": zeros, "start": zeros, "text": texts}), 20)
    assert shard.automaton.get_stats()["nodes_count"] <= 50 * 200
    # words of one letter in the automaton, but of other hashes: what it finds wrongly is no occurrence
    letter = lambda w: int(text_hashes(w)[0]) >> 57
    words = texts[7].split(" ")
    alike = [next(w for w in (f"{x}x{j}" for j in range(10**6)) if letter(w) == letter(x)) for x in words]
    rows = [" ".join(alike), " ".join(alike[:30] + words[30:55] + alike[55:])]
    assert list(shard.occurrences(np.array([90, 91]), np.zeros(2, int), np.zeros(2, int), rows)) == [(1, 30, 25)]
