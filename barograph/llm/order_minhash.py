"""Document fingerprints by order min-hash.

Every k-mer of a text is numbered among its equals. For each of ``m`` hash functions the ``ell``
numbered k-mers with the smallest hashes are put back in text order and hashed as a tuple. Two
texts agree in a component if they share those k-mers in the same order, so that the share
of equal components follows edit distance and not only the set of k-mers.

A share ``p`` of equal components is told with a standard error of ``sqrt(p (1 - p) / m)``: 0.031 at most with the
256 functions taken here.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barograph.llm.common import MIX_A, MIX_B, MIX_C, mixed, table

#: k-mers hashed at a time for all functions, which bounds the memory of a task.
BLOCK = 4096
#: Functions taken at a time, and those of them that share what they flip.
ROWS, SHARE = 256, 32


class OrderMinHash:
    def __init__(self, k: int = 5, ell: int = 2, m: int = 256, seed: int = 1):
        self.k, self.ell, self.m = k, ell, m
        draw = np.random.default_rng(seed)
        # functions that share what they flip differ in what they multiply by
        self.flip = np.repeat(draw.integers(0, 1 << 32, (-(-m // SHARE), 1), np.uint32), SHARE, 0)[:m]
        self.room = np.empty(ROWS * BLOCK, np.uint32)  # for a block of hashes
        self.times = draw.integers(0, 1 << 31, (m, 1), np.uint32) * np.uint32(2) + np.uint32(1)

    def numbered(self, text: str) -> np.ndarray:
        """64-bit hash of each k-mer with its occurrence number; a shorter text is one k-mer."""
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if not len(a):
            return a
        k, n = min(self.k, len(a)), max(1, len(a) - self.k + 1)
        code = np.full(n, k, np.uint64)
        for j in range(0, k, 3):  # three code points of 21 bits at a time
            three = a[j : j + n].copy()
            for i in range(j + 1, min(j + 3, k)):
                three |= a[i : i + n] << np.uint64(21 * (i - j))
            code ^= three
            code *= MIX_A
            code ^= code >> np.uint64(29)
        code *= MIX_B
        # equals are found by sorting the upper bits of each code with its place in the lower ones
        bits, places = np.uint64(max(1, (n - 1).bit_length())), np.arange(n, dtype=np.uint64)
        packed = code >> bits << bits | places
        packed.sort()
        same = packed >> bits
        new = np.concatenate(([True], same[1:] != same[:-1]))
        number = np.empty(n, np.uint64)
        number[packed & ((np.uint64(1) << bits) - np.uint64(1))] = places - np.maximum.accumulate(np.where(new, places, np.uint64(0)))
        number *= MIX_C
        code ^= number
        code ^= code >> np.uint64(31)
        code *= MIX_C
        return code

    def smallest(self, each: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the k-mers ``start`` to ``stop``, for each function the ``ell`` smallest hashes and their places."""
        low = (each[start:stop] >> np.uint64(32)).astype(np.uint32)
        parts = [self.smallest_of(low, start, self.flip[j : j + ROWS], self.times[j : j + ROWS]) for j in range(0, self.m, ROWS)]
        return np.concatenate([b for b, _ in parts]), np.concatenate([p for _, p in parts])

    def smallest_of(self, low: np.ndarray, start: int, flip: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(flip))
        best, place = np.empty((len(flip), 0), np.uint32), np.empty((len(flip), 0), np.int64)
        for at in range(0, len(low), BLOCK):
            part = low[at : at + BLOCK]
            h = self.room[: len(flip) * len(part)].reshape(len(flip), len(part))
            for j in range(0, len(flip), SHARE):
                np.multiply(part ^ flip[j], times[j : j + SHARE], out=h[j : j + SHARE])
            for _ in range(min(self.ell, h.shape[1])):
                least = h.argmin(1)
                best, place = np.concatenate((best, h[rows, least][:, None]), 1), np.concatenate((place, least[:, None] + (start + at)), 1)
                h[rows, least] = 0xFFFFFFFF
            if best.shape[1] > 8 * self.ell:
                best, place = self.least(best, place, self.ell)
        return (best, place) if best.shape[1] <= self.ell else self.least(best, place, self.ell)

    def components(self, each: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """``m`` components of 16 bits, from the smallest of each part of a text's k-mers; none for an empty text."""
        ell = min(self.ell, len(each))
        if not ell:
            return np.zeros(0, np.uint16)
        _, place = self.least(np.concatenate([b for b, _ in parts], 1), np.concatenate([p for _, p in parts], 1), ell)
        place.sort(1)  # text order
        code = np.full(self.m, ell, np.uint64)
        for j in range(ell):
            code = mixed(code * MIX_A + each[place[:, j]])
        return (code >> np.uint64(48)).astype(np.uint16)

    def sketch(self, text: str) -> np.ndarray:
        each = self.numbered(text)
        return self.components(each, [self.smallest(each, 0, len(each))])

    @staticmethod
    def least(best: np.ndarray, place: np.ndarray, ell: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ell`` smallest of each row; of equals the earlier place."""
        order = np.lexsort((place, best))[:, :ell]
        return np.take_along_axis(best, order, 1), np.take_along_axis(place, order, 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components; 1 for two empty texts, 0 if one is empty."""
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def written(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u2").tobytes()).decode()


def fingerprints(docs: DataFrame, hasher: OrderMinHash | None = None, text_col: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text; a null text counts as empty and has an empty one."""
    omh, kept = hasher or OrderMinHash(), docs.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [written(omh.sketch(t or "")) for t in b[text_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(each, pa.string())], [*b.schema.names, to])

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add(to, "string"))


def how_many_up_to(bounds: list[int], x: Column) -> Column:
    """How many of the sorted ``bounds`` are ``x`` at most, by binary search; the bounds are one value in the plan."""
    known = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    low, high = F.lit(0), F.lit(len(bounds))

    def step(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        right = F.get(known, middle) <= x
        going = s["low"] < s["high"]
        return F.struct(F.when(going & right, middle + 1).otherwise(s["low"]).alias("low"), F.when(going & ~right, middle).otherwise(s["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), F.struct(low.alias("low"), high.alias("high")), step)["low"] if bounds else F.lit(0)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents sorted by id in buckets, each followed by the first document after its bucket.

    Columns id, text, bucket, ahead (0: the bucket's own, 1: the one that only follows). Buckets are ranges
    of ids, some to a partition and sorted within it; after the last document comes the first. A text is shuffled
    once, and no task sees more than its ranges. Null ids come first; of equal ids the smaller text. Ids must be whole numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bounds = sorted({int(x) for x in rows.approxQuantile("id", [i / buckets for i in range(1, buckets)], 1 / (8 * buckets)) or []})
    bucket = F.when(F.col("id").isNull(), 0).otherwise(how_many_up_to(bounds, F.col("id"))).cast("int")
    # one row a bucket: at most ``buckets`` of them reach the driver
    heads = sorted((r.bucket, r.null_ids, r.head) for r in rows.select("id", bucket.alias("bucket")).groupBy("bucket").agg(F.min("id").alias("head"), F.max(F.col("id").isNull()).alias("null_ids")).collect())
    if not heads:
        return rows.select("id", "text", F.lit(0).alias("bucket"), F.lit(0).alias("ahead"))
    # by bucket: its first id (null: a null, or no document), and the bucket before
    first, before = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for k, (b, null_ids, head) in enumerate(heads):
        first[b], before[b] = None if null_ids else head, heads[k - 1][0]
    listed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<{kind}>")
    placed = rows.withColumn("own", bucket)
    leads = F.col("id").eqNullSafe(F.get(listed(first, "bigint"), F.col("own")))
    own = F.struct(F.col("own").alias("bucket"), F.lit(0).alias("ahead"))
    also = F.struct(F.get(listed(before, "int"), F.col("own")).alias("bucket"), F.lit(1).alias("ahead"))
    placed = placed.select("id", "text", F.explode(F.when(leads, F.array(own, also)).otherwise(F.array(own))).alias("at")).select("id", "text", "at.*")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.asc_nulls_first("id"), "text")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edited text: its second half replaced by the next document's start."""
    omh = OrderMinHash()
    untouched = lambda text: max(0, len(text) - len(text) // 2 - omh.k + 1)  # k-mers that the edit leaves as they are
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, ahead, id, text, smallest of the part that stays, fingerprint: of the row before
        for b in batches:
            out = []
            for i, text, bucket, ahead in zip(*(b[c].to_pylist() for c in ("id", "text", "bucket", "ahead")), strict=True):
                if last and last[0] == bucket and last[1]:
                    continue  # a second row with the id that follows the bucket
                each, seam = omh.numbered(text), untouched(text)
                head = omh.smallest(each, 0, seam)
                sketch = omh.components(each, [head, omh.smallest(each, seam, len(each))])
                if last and last[0] == bucket:
                    _, _, last_id, old, old_head, old_sketch = last
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    changed = omh.numbered(edited)
                    other = omh.components(changed, [old_head, omh.smallest(changed, untouched(old), len(changed))])
                    out.append((last_id, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(old_sketch), written(other), likeness(old_sketch, other), likeness(old_sketch, sketch)))
                last = (bucket, ahead, i, text, head, sketch)
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], kinds)

    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    names = kinds.names
    return with_next(table(spark, sf_dir, "documents")).mapInArrow(run, schema)
