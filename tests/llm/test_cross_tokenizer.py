import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barograph.llm import cross_tokenizer as ct

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "\n", "a", "  two  spaces\n\nand lines \n x", "it's the dog's <|endoftext|> <s> </s> <0x41> x", "tab\tand\r\nreturn;\r\n}\r\n x", "a  b   c  \n d", "▁ marks ▁", "one ▁word",
    "你好世界 \U0001f600\U0001f600 é ́x", "　wide　 space", "\x1c x\x1f y\x85 z", "\x00 nul \x00", "x" * 5000, "1,234.5 99%...!!  ??\v\f ", "end with blanks   ",
]


def whole(texts):
    """The contract by whole texts, without segments."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = ct.byte_alphabet()
    groups = []
    for t in texts:
        groups.append([])
        if not t:
            continue
        raw = (" " + t).encode()
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            continue
        ends_a, ends_b = list(accumulate(map(len, bytes_a))), list(accumulate(map(len, bytes_b)))
        i = j = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups[-1].append((ids_a[i:p], ids_b[j:q]))
            i, j = p, q
    count = Counter((x[-1], y[-1]) for g in groups for x, y in g)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    for g in groups:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        links = [(x[-1], y[-1]) for x, y in g]
        yield (
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        )


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in ct.op11_cross_tokenizer(spark, sf).collect()}
    assert got == dict(zip(docs, whole(docs.values()), strict=True)) and any(r[0] for r in got.values())


def test_hard_texts(spark):
    rows = [(str(i), t, 1, "x") for i, t in enumerate(HARD + HARD[4:9])] + [(None, "it's the dog's"), (None, "it's the dog's")]
    rows = [(*r, 1, "x")[:4] for r in rows]
    docs = spark.createDataFrame(rows, "id string, text string, n_a int, seg string")
    want = sorted(((i, *w) for (i, *_), w in zip(rows, whole([r[1] for r in rows]), strict=True)), key=str)
    got = sorted((tuple(r)[:-1] + (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "",) for r in ct.align(docs, A, B, id_col="id").collect()), key=str)
    assert got == want
    assert [w[0] == 0 for w in whole(["▁ marks"])] == [True]


def test_random_texts_cut_at_every_allowed_place():
    draw, aligner = random.Random(5), ct.Aligner(A, B)
    alphabet = [" ", "  ", "\n", "\r", "\r\n", "\t", " ", "　", "a", "the", "é", "ß", ";", "})", "'s", "12", "你", "\x1f", "_", "..."]
    for _ in range(3000):
        text = " " + "".join(draw.choices(alphabet, k=draw.randint(1, 25)))
        parts = aligner.cutter.of(text)
        assert "".join(parts) == text
        assert sum(aligner.a.of(parts), []) == aligner.a.of([text])[0]
        assert sum(aligner.b.of(parts), []) == aligner.b.coder.encode(text[1:])


def test_cuts_that_a_vocabulary_forbids():
    across = ct.reaching_across([b"x y", b" \xc2\xa0 ", b";\r", b"  "])
    assert across == {("x", " "), (" ", " "), (";", "\r")}
    assert ct.Segmenter(across).of(" ax y;\rb c\rd") == [" ax y;\rb", " c", "\rd"]
    with pytest.raises(ValueError, match="part of a character"):
        ct.Segmenter(ct.reaching_across([b"\xa0 x"]))


def test_empty_table_and_other_blocks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    assert ct.align(docs.limit(0), A, B).count() == 0
    want = sorted(map(tuple, ct.align(docs, A, B).collect()), key=str)
    assert sorted(map(tuple, ct.align(docs.repartition(7), A, B).collect()), key=str) == want
    assert {r.n_a for r in ct.align(docs.withColumn("text", F.lit(None).cast("string")), A, B).collect()} == {0}
