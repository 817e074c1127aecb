import random
import zlib

import pytest
from tokenizers import Tokenizer

from barograph.llm.packing import op6_packing, pack, plan_bins, token_pieces, tokenizer_path


def check_places(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for each in bins.values():
        end = 0
        for offset, length in sorted(each):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r.asDict() for r in op6_packing(spark, sf).collect()]
    coder = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i, t in docs.items():
        ids = [*coder.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048] = (k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    n = check_places(rows, 2048)
    assert n <= 1.03 * -(-sum(x[1] for x in want.values()) // 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece_and_is_tight(seed):
    draw = random.Random(seed)
    capacity = 100
    counts = {s: draw.randint(1, 400) for s in draw.sample(range(1, 101), draw.randint(1, 40))}
    plan = plan_bins(counts, capacity)
    assert all(sum(s * k for s, k in has) <= capacity for _, has in plan)
    packed = {}
    for n, has in plan:
        for s, k in has:
            packed[s] = packed.get(s, 0) + n * k
        assert sum(k for s, k in has if 3 * s > capacity) <= 2
    assert packed == counts
    # first-fit decreasing, one piece at a time, is a fair yardstick
    free = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, f in enumerate(free) if f >= s), None)
        if at is None:
            free.append(capacity - s)
        else:
            free[at] -= s
    assert sum(n for n, _ in plan) <= 1.05 * len(free) + 1


HARD = [None, "", "hi <|endoftext|> there", "a<|startoftext|>b <|ENDOFTEXT|>", "it's the dog's, we'll see...\t\n\x0b\x0c\r x", "J\u030c e\u0301 \u0301x A\u030a", "a\u2000b\u00a0c\u3000d\x1ce", "\u03a3\u03a3 \u0130x 1,234.5 [[[] !!\n!!", "\u0000 \ud7ff \U0001f600", "x" * 3000]


@pytest.mark.parametrize("by_word", [True, False])
def test_ids_are_those_of_whole_texts(spark, by_word):
    rows = list(enumerate(HARD))
    got = token_pieces(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), by_word=by_word).collect()
    coder = Tokenizer.from_file(tokenizer_path())
    for i, text in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        assert [(r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i] == [(0, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))]
    assert 49407 in coder.encode(HARD[2], add_special_tokens=False).ids


def test_rows_that_are_equal_in_all_columns(spark):
    rows = spark.range(5000).selectExpr("7L as length", "map('a', 1) as tag")
    got = [r.asDict() for r in pack(rows, 100).collect()]
    assert len(got) == 5000 and check_places(got, 100) == -(-5000 // 14)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "w " * 30_000), (None, "a b")], "doc_id long, text string")
    rows = [r.asDict() for r in pack(token_pieces(docs, tokenizer_path())).collect()]
    assert sum(r["length"] for r in rows) == 1 + 1 + 1 + 30_001 + 3 and len([r for r in rows if r["doc_id"] == 3]) == 15
    assert check_places(rows, 2048) == 15
    assert pack(token_pieces(docs.limit(0), tokenizer_path())).count() == 0
    other = spark.createDataFrame([(4, "x", 9), (4, "y", 8), (4, "y", 8)], "length long, offset string, sequence_id long")
    assert check_places([r.asDict() for r in pack(other, 10).collect()], 10) == 2
    with pytest.raises(Exception, match="capacity"):
        pack(spark.createDataFrame([(11,)], "length long"), 10).count()
