"""Best-fit packing of token pieces into sequences, by large-item matching.

Lengths are whole numbers up to the capacity, so that a table of counts by length holds all that a
packer needs: at most ``capacity`` numbers, whatever the corpus. Pieces over a third of the capacity are
matched greedily, at most two to a bin; smaller ones go, longest first, where they leave the smallest gap. The
plan says how many bins have which lengths; each piece then finds its place by its rank among those of its length.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.llm.common import cut, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker remembers, some 200 bytes each, before it starts afresh.
CACHE_WORDS = 1_500_000


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit values."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Ids of words (UTF-8 without white space), which are remembered.

    For tokenizers as word_bpe_49k: they drop white space, lower-case, part letters from all else, and let no token,
    rule or marker reach across white space, so that a text's ids are those of its words. A word of Latin letters (up to
    U+00FF) goes to the tokenizer's model as it is, and a full stop or comma behind one is a word of its own.
    """

    def __init__(self, coder):
        from tokenizers.pre_tokenizers import ByteLevel

        self.coder, self.model, self.spelt = coder, coder.model, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        stem = text[:-1] if text[-1] in ".," else text
        if stem.isalpha() and (stem.isascii() or max(stem) <= "\u00ff"):
            low = stem.lower()
            if stem != text:
                ids = self[stem.encode()] + self[word[-1:]]
            elif low != text:
                ids = self[low.encode()]
            else:
                ids = packed_ids([t.id for t in self.model.tokenize(text if text.isascii() else self.spelt(text)[0][0])])
        else:
            ids = packed_ids(self.coder.encode(text, add_special_tokens=False).ids)
        self[word] = ids
        return ids


class Coder:
    """Ids of whole texts. ``by_word`` is for tokenizers that WordIds is right for; with others texts go in whole."""

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.known = WordIds(self.coder) if by_word else None

    def of(self, texts: list[str]) -> list[bytes]:
        if self.known is None:
            return [packed_ids(e.ids) for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        # words end at \x20 and \x09 to \x0D; other white space stays inside of a word
        return [b"".join(map(self.known.__getitem__, text.encode().split())) for text in texts]


#: Coders of this worker: what they remember serves all of its tasks.
_coders: dict[tuple[str, bool], Coder] = {}


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, by_word: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids and a final ``end_id``: PIECES. Only longer documents are cut.

    A null text counts as empty: one piece of one id. Rows that repeat an id are documents of their own. Ids must be
    whole numbers or null. A special token's string in a text is that token, as tokenizers has it. ``by_word``: see WordIds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, by_word) not in _coders:
            _coders[path, by_word] = Coder(path, by_word)
        coder, end = _coders[path, by_word], struct.pack("<I", end_id)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, ids in zip(b["id"].to_pylist(), coder.of([t or "" for t in b["text"].to_pylist()]), strict=True):
                ids += end
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    for column, x in zip(out, (i, k, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, how many in each bin)]) for all pieces of the given counts by length.

    Bins of the same contents are handled as one entry, so that work and result depend on the
    number of lengths only.
    """
    left, bins = dict(counts), []  # bins: [gap, number, contents]
    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for s in large:  # each with the longest that still fits beside it
        while left[s]:
            mate = next((x for x in large if x <= s and x + s <= capacity and left[x] > (x == s)), None)
            n = left[s] if mate is None else left[s] // 2 if mate == s else min(left[s], left[mate])
            bins.append([capacity - s - (mate or 0), n, [(s, 1)] if mate is None else [(s, 2)] if mate == s else [(s, 1), (mate, 1)]])
            for x in (s, mate):
                if x is not None:
                    left[x] -= n
    heap: dict[int, list] = {}
    for b in bins:
        heap.setdefault(b[0], []).append(b)
    gaps = sorted(heap)
    for s in sorted((s for s in counts if 3 * s <= capacity and counts[s]), reverse=True):
        need = counts[s]
        while need:
            at = next((g for g in gaps[bisect_right(gaps, s - 1) :] if heap[g]), None)
            if at is None:
                b = [capacity, need, []]
                b[1] = max(1, need // (capacity // s))
            else:
                b = heap[at].pop()
            gap, n, has = b
            per = min(gap // s, need)
            used = min(n, need // per)
            if used < n and at is not None:
                heap[at].append([gap, n - used, has])
            made = [gap - per * s, used, [*has, (s, per)]]
            need -= used * per
            if made[0] not in heap:
                heap[made[0]] = []
                gaps.insert(bisect_right(gaps, made[0]), made[0])
            heap[made[0]].append(made)
            if at is not None and not heap[at]:
                del heap[at]
                gaps.remove(at)
    return [(n, has) for g in sorted(heap) for _, n, has in heap[g] if n]


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: first rank of each run of bins, and (first bin, offset, how many in each bin)."""
    runs: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for n, has in plan:
        offset = 0
        for s, per in has:
            runs.setdefault(s, []).append((used.get(s, 0), first, offset, per))
            used[s] = used.get(s, 0) + n * per
            offset += s * per
        first += n
    return {s: (np.array([x[0] for x in v]), np.array([x[1:] for x in v])) for s, v in runs.items()}


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset. Lengths are 1 to ``capacity``; others, and nulls, raise an error.

    Ranks among pieces of a length come from counts by (length, bucket), so that a length that most
    pieces have is ranked by many tasks. Counts by length and the plan are the only things that meet on
    the driver; both are bounded by the capacity.
    """
    spark = pieces.sparkSession
    kept = pieces.drop("sequence_id", "offset", "_pk_row", "_pk_bucket", "_pk_rank", "_pk_before")
    columns = kept.columns
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fits = F.when(F.col(length_col).between(1, capacity), F.col(length_col)).otherwise(F.raise_error(F.lit("a piece's length is not from 1 to the capacity")).cast("long"))
    # a row's number is written once, so that equal rows, too, keep their order and are dealt to many buckets
    kept = cut(kept.withColumns({length_col: fits, "_pk_row": F.monotonically_increasing_id()}), "pieces").withColumn("_pk_bucket", F.pmod(F.xxhash64("_pk_row"), F.lit(buckets)).cast("int"))
    counts = kept.groupBy(length_col, "_pk_bucket").agg(F.count("*").alias("n"))
    total = {r[0]: r.n for r in counts.groupBy(length_col).agg(F.sum("n").alias("n")).collect()}
    where = places(plan_bins(total, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(length_col).orderBy("_pk_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = counts.select(length_col, "_pk_bucket", before.alias("_pk_before"))
    rank = F.row_number().over(Window.partitionBy(length_col, "_pk_bucket").orderBy("_pk_row")) - 1
    ranked = kept.withColumn("_pk_rank", rank).join(start, [length_col, "_pk_bucket"]).select(*columns, (F.col("_pk_rank") + F.col("_pk_before")).alias("_pk_rank"))
    schema = ranked.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b[length_col].to_numpy(zero_copy_only=False), b["_pk_rank"].to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                mine = np.flatnonzero(length == s)
                begin, at = where[int(s)]
                k = np.searchsorted(begin, rank[mine], "right") - 1
                first, place, per = at[k].T
                nth = rank[mine] - begin[k]
                sequence[mine], offset[mine] = first + nth // per, place + nth % per * s
            yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), by_word=True))
