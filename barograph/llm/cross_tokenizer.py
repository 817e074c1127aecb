"""Cross-tokenizer alignment by segment deduplication.

A text is cut before white space that follows other characters, wherever no entry of either vocabulary
reaches across the cut, so that the ids of a text are those of its segments in a row. Each task numbers the segments
of its documents in blocks; distinct segments of the corpus are tokenised and aligned once; alignments are joined back to
the blocks' segments, and documents are composed from them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import BLANKS, cut, forget, table

#: A block of documents ends when it has so many distinct segments, or so many segments in all.
BLOCK_DISTINCT, BLOCK_SEGMENTS = 1 << 19, 1 << 22
#: Segments of a block in a row.
SLICE = 2048
#: Segments that a task tokenises at once.
BATCH = 20_000
ALIGNED = "seg string, exact boolean, n_a long, n_b long, n_groups long, groups string, la array<int>, lb array<int>"


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable Latin-1 stands for itself, others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteCoder:
    """Ids of a byte-level BPE of tokenizers; strings of special tokens are plain text. ``spelt[i]`` is the bytes of id i."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        alphabet, special = byte_alphabet(), {i for i, t in self.coder.get_added_tokens_decoder().items() if t.special}
        vocabulary = self.coder.get_vocab(with_added_tokens=True)
        self.spelt = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if i not in special:
                self.spelt[i] = bytes(map(alphabet.__getitem__, token))

    def of(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast(segments, add_special_tokens=False)]


class PieceCoder:
    """Ids of a sentencepiece BPE for segments of a text that has got a space in front.

    The library puts that space before whatever it encodes. A segment that starts with a space is therefore handed over
    without it, and others behind a newline, whose two ids are dropped: no piece holds a newline.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.coder = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelt = []
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            self.spelt.append(bytes([int(piece[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) else piece.replace("▁", " ").encode())
        self.lead = p.encode("\n")
        if any(b"\n" in s and s != b"\n" for s in self.spelt):
            raise ValueError("a piece holds a newline, so it can't part a segment from the space in front")

    def of(self, segments: list[str]) -> list[list[int]]:
        plain = [s[0] == " " and len(s) > 1 for s in segments]
        coded = self.coder.encode([s[1:] if p else "\n" + s for s, p in zip(segments, plain, strict=True)], num_threads=1)
        return [ids if p else ids[len(self.lead) :] for ids, p in zip(coded, plain, strict=True)]


def reaching_across(vocabulary: Iterable[bytes]) -> set[tuple[str, str]]:
    """(character, blank) pairs that stand side by side inside of some entry; a cut between them could part a token.

    Where an entry has only a part of the character, that is ''.
    """
    blanks, found = BLANKS.encode(), set()
    for entry in vocabulary:
        for k in range(1, len(entry)):
            if entry[k] in blanks and entry[k - 1] not in blanks:
                last = entry[:k].decode(errors="replace")[-1]
                found.add(("" if last == "�" else last, chr(entry[k])))
    return found


class Segmenter:
    """Cuts a text before runs of blanks; ``across`` are pairs at which it doesn't."""

    pieces = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")

    def __init__(self, across: set[tuple[str, str]]):
        if any(not last for last, _ in across):
            raise ValueError("an entry holds a part of a character before a blank")
        self.across = {p for p in across if not p[0].isspace()}
        odd = {c for c in map(chr, range(0x3001)) if c.isspace() and c not in BLANKS} | {blank for _, blank in self.across}
        self.odd = re.compile("[" + re.escape("".join(sorted(odd))) + "]")

    def of(self, text: str) -> list[str]:
        found = self.pieces.findall(text)
        if not self.odd.search(text):
            return found
        # other white space before a blank belongs to the blanks for a tokenizer's rules
        keep = [k for k in range(1, len(found)) if not found[k - 1][-1].isspace() and (found[k - 1][-1], found[k][0]) not in self.across]
        bounds = [0, *keep, len(found)]
        return ["".join(found[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def align_ids(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[tuple[list[int], list[int]]]:
    """Groups of ids between the byte offsets at which a token of either side ends."""
    if len(a) == 1 or len(b) == 1:
        return [(a, b)]
    out, i, j, first_a, first_b, end_a, end_b = [], 0, 0, 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if end_a <= end_b:
            end_a, i = end_a + size_a[a[i]], i + 1
        else:
            end_b, j = end_b + size_b[b[j]], j + 1
        if end_a == end_b:
            out.append((a[first_a:i], b[first_b:j]))
            first_a, first_b = i, j
    return out


class Aligner:
    """Both coders of a worker, the cuts that they allow, and alignments of segments."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteCoder(path_a), PieceCoder(path_b)
        self.cutter = Segmenter(reaching_across(self.a.spelt) | reaching_across(self.b.spelt))
        self.sizes = [len(s) for s in self.a.spelt], [len(s) for s in self.b.spelt]

    def aligned(self, segments: list[str]) -> Iterator[tuple]:
        """Rows of ALIGNED."""
        spelt_a, spelt_b = self.a.spelt.__getitem__, self.b.spelt.__getitem__
        for seg, a, b in zip(segments, self.a.of(segments), self.b.of(segments), strict=True):
            raw = seg.encode()
            if b"".join(map(spelt_a, a)) != raw or b"".join(map(spelt_b, b)) != raw:
                yield seg, False, 0, 0, 0, "", [], []
                continue
            groups = align_ids(a, b, *self.sizes)
            text = ";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups])
            yield seg, True, len(a), len(b), len(groups), text, [x[-1] for x, _ in groups], [y[-1] for _, y in groups]


#: Aligners of this worker.
_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


class _Numbers(dict):
    def __missing__(self, segment: str) -> int:
        n = self[segment] = len(self)
        return n


def _number_segments(path_a: str, path_b: str, id_type: pa.DataType) -> Callable:
    """Rows of documents (block, id, codes) and, at the end of each block, of its segments and how often each occurs, SLICE to a row."""
    names = ["block", "id", "codes", "first", "segs", "counts"]
    kinds = [pa.int64(), id_type, pa.binary(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _aligner(path_a, path_b).cutter
        block, numbers, counts, total = TaskContext.get().partitionId() << 32, _Numbers(), np.zeros(0, np.int64), 0

        def closed() -> Iterator[pa.RecordBatch]:
            segments = list(numbers)
            for i in range(0, len(segments), SLICE):
                row = (block, None, None, i, segments[i : i + SLICE], counts[i : i + SLICE].tolist())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                codes, lot = [], []
                for text in part["text"].to_pylist():
                    lot.append(np.fromiter(map(numbers.__getitem__, cutter.of(" " + text)), np.uint32) if text else None)
                    codes.append(None if lot[-1] is None else packed(lot[-1]))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(codes), kinds[0]), part["id"], pa.array(codes, kinds[2]), *(pa.nulls(len(codes), k) for k in kinds[3:])], names)
                lot = [c for c in lot if c is not None]
                if lot:
                    both = np.bincount(np.concatenate(lot), minlength=len(numbers))
                    both[: len(counts)] += counts
                    counts, total = both, total + sum(map(len, lot))
                if len(numbers) >= BLOCK_DISTINCT or total >= BLOCK_SEGMENTS:
                    yield from closed()
                    block, numbers, counts, total = block + 1, _Numbers(), np.zeros(0, np.int64), 0
        if numbers:
            yield from closed()

    return run


def packed(codes: np.ndarray) -> bytes:
    """Segment numbers as their count and zstd of their lowest bytes, then of the next ones, and so on."""
    return len(codes).to_bytes(8, "little") + pa.compress(codes.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd"), np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel()


def _codes(docs: pa.Table) -> Iterator[np.ndarray | None]:
    for c in docs["codes"]:
        yield unpacked(c.as_py()) if c.is_valid else None


def _uncounted(docs: pa.Table, bad: pa.Table) -> pa.Table:
    """How often the block's segments occur in documents that hold one of the ``bad`` ones."""
    codes = [c for c in _codes(docs) if c is not None and len(c)]
    wrong = bad["code"].to_numpy()
    codes = [c for c in codes if np.isin(c, wrong).any()]
    code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    block = docs["block"][0] if docs.num_rows else None
    return pa.table({"at": pa.array([block.as_py() if block else 0] * len(code), pa.int64()), "code": pa.array(code.astype(np.int32)), "n": pa.array(-n.astype(np.int64))})


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


#: Entries that a task holds before it parts them by block, and what a part of them is.
PIECE_ROWS = 1 << 17
PIECE = pa.schema([("code", pa.int32()), ("exact", pa.bool_()), *((c, pa.int64()) for c in SUMS), ("groups", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries as compressed tables by block, which shuffle for a third of what rows do."""

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        blocks = np.concatenate([b["at"].to_numpy() for b in held])
        order = np.argsort(blocks, kind="stable")
        whole = pa.Table.from_batches([b.select(PIECE.names).cast(PIECE) for b in held]).take(order)
        of, starts = np.unique(blocks[order], return_index=True)
        pieces = []
        for i, j in zip(starts, [*starts[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with ipc.new_stream(sink, PIECE, options=ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole.slice(i, j - i).combine_chunks())
            pieces.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(pieces, pa.binary())], ["at", "piece"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PIECE_ROWS:
            yield dealt(held)
            held, n = [], 0
    if n:
        yield dealt(held)


def _compose(docs: pa.Table, pieces: pa.Table) -> pa.Table:
    """Sums and groups of each document of a block from those of its segments."""
    entries = pa.concat_tables([PIECE.empty_table(), *(ipc.open_stream(x.as_buffer()).read_all() for x in pieces["piece"])]).combine_chunks()
    order = np.argsort(entries["code"].to_numpy())
    of = {c: entries[c].to_numpy()[order] for c in ("exact", *SUMS)}
    groups = entries["groups"].to_numpy(zero_copy_only=False)[order]
    sums, texts = [], []
    for codes in _codes(docs):
        if codes is None or not of["exact"][codes].all():
            sums.append([0] * len(SUMS))
            texts.append("")
        else:
            sums.append([int(of[c][codes].sum()) for c in SUMS])
            texts.append(";".join(groups[codes]))
    columns = np.array(sums, np.int64).reshape(-1, len(SUMS)).T
    return pa.table({"id": docs["id"], **{c: pa.array(x) for c, x in zip(SUMS, columns, strict=True)}, "groups": pa.array(texts, pa.string())})


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment of space+text under a byte-level BPE (A) and a sentencepiece BPE (B), one row for each row of ``docs``.

    Columns: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum (longs) and groups
    (``a1,a2|b1;a3|b2,b3``). A group ends at each byte offset at which tokens of both end, and these two are linked; a
    pair's count is the number of its links in all rows. n_best counts links whose count is the highest of
    their B id (ties included), count_sum adds the counts up.

    Null and empty texts, and texts that either vocabulary doesn't spell back byte for byte, have zeros and an empty
    groups. Rows that repeat an id or a text are documents of their own, and ids may be null or of any type; other
    columns of ``docs`` aren't read. A text of any length is one row of one task, its segments 4 bytes each. A block's segments
    are bounded (BLOCK_DISTINCT and one document's); corpus-wide, segments and pairs are only joined and summed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"block long, id {id_type.simpleString()}, codes binary, first int, segs array<string>, counts array<bigint>"
    coded = cut(rows.mapInArrow(_number_segments(path_a, path_b, to_arrow_type(id_type)), schema), "coded", "zstd")
    numbered = coded.where("segs is null").select("block", "id", "codes")
    entries = coded.where("segs is not null").select(F.col("block").alias("at"), "first", F.posexplode(F.arrays_zip("segs", "counts")).alias("k", "e")).select("at", (F.col("first") + F.col("k")).alias("code"), F.col("e.segs").alias("seg"), F.col("e.counts").alias("n"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _aligner(path_a, path_b)
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in ALIGNED.split(", ")] + ["n"]
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                columns = zip(*coder.aligned(part["seg"].to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, kinds, strict=True)), part["n"]], names)

    known = entries.groupBy("seg").agg(F.sum("n").alias("n")).mapInArrow(aligned, ALIGNED + ", n long")
    known = cut(known.withColumn("k", F.monotonically_increasing_id()), "aligned-segments", "zstd")
    counted = known
    wrong = known.where("not exact").select("seg")
    if not wrong.isEmpty():  # links of documents that hold such a segment don't count
        bad = cut(entries.join(wrong, "seg").select("at", "code"), "inexact-segments")
        held = numbered.join(bad.select(F.col("at").alias("block")).distinct(), "block", "left_semi")
        less = held.groupBy("block").cogroup(bad.groupBy("at")).applyInArrow(_uncounted, "at long, code int, n long")
        less = less.join(entries.select("at", "code", "seg"), ["at", "code"]).groupBy("seg").agg(F.sum("n").alias("less"))
        counted = known.join(less, "seg", "left").withColumn("n", F.col("n") + F.coalesce("less", F.lit(0)))

    links = counted.where("exact").select("k", "n", F.explode(F.arrays_zip("la", "lb")).alias("p")).select("k", "n", "p.la", "p.lb")
    pairs = cut(links.groupBy("la", "lb").agg(F.sum("n").alias("c")), "id-pairs")
    top = pairs.groupBy("lb").agg(F.max("c").alias("top"))
    pairs = pairs.join(top, "lb").select("la", "lb", "c", (F.col("c") == F.col("top")).cast("long").alias("best"))
    sums = links.drop("n").join(pairs, ["la", "lb"]).groupBy("k").agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("c").alias("count_sum"))
    scored = known.select("k", "seg", "exact", "n_a", "n_b", "n_groups", "groups").join(sums, "k", "left").drop("k").fillna(0, ["n_links", "n_best", "count_sum"])
    scored = cut(scored, "scored-segments", "zstd")
    forget(known)
    pieces = entries.drop("n").join(scored, "seg").drop("seg").mapInArrow(_pieces, "at long, piece binary")

    out = f"id {id_type.simpleString()}, {', '.join(f'{c} long' for c in SUMS)}, groups string"
    return numbered.groupBy("block").cogroup(pieces.groupBy("at")).applyInArrow(_compose, out).withColumnRenamed("id", id_col)


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return out.select("doc_id", *SUMS, digest.alias("groups_sha256"))
