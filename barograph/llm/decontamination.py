"""Benchmark decontamination: find short test items inside long documents.

A size-partitioned min-hash containment search. Items are partitioned by the number of their shingles, and each
partition has its own number ``k`` of minima: an item of at most ``u`` shingles whose share ``t`` is in a document
can lack ``u - t u`` of them, so that one of its ``k = u - t u + 1`` smallest hashes must be there. A document is
held against an item only if it has one of the item's minima; such pairs are verified by exact containment of the shingle set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from barograph.llm.common import WordHashes, cut, gram_hashes, hash_filter, in_filter, table

WORD = re.compile(r"\w+")


def words_in(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores: case and punctuation hide no test item."""
    return WORD.findall((text or "").lower())


def minima_of(n: int, percent: int) -> int:
    """How many minima stand for an item of ``n`` shingles: by the upper end of its partition (powers of two)."""
    upper = (1 << n.bit_length()) - 1
    return min(n, upper - -(-percent * upper // 100) + 1)


def item_index(items: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Rows item_id, copies, n, width, hash, minimum: a row for each shingle of each distinct item.

    An item of fewer words is one shingle, ``width`` words wide; one without words has no row. Items with
    equal shingle sets are one, under the smallest id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            rows: list[dict] = []
            for i, text in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                w = cache.of(words_in(text))
                if len(w):
                    each = np.unique(gram_hashes(w, min(words, len(w))))
                    rows.append({"id": i, "width": min(words, len(w)), "k": minima_of(len(each), percent), "each": each.view(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("width", pa.int32()), ("k", pa.int32()), ("each", pa.list_(pa.int64()))]))

    sets = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, width int, k int, each array<long>")
    distinct = sets.groupBy("width", "k", "each").agg(F.min("id").alias("item_id"), F.count("*").alias("copies"))
    return distinct.select("item_id", "copies", F.size("each").alias("n"), "width", "k", F.posexplode("each").alias("place", "hash")).select("item_id", "copies", "n", "width", "hash", (F.col("place") < F.col("k")).alias("minimum"))


def candidates(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct id, text_hash, item_id of documents (rows id, text_hash, hash) that have one of an item's minima."""
    minima = index.where("minimum").select("hash", "item_id")
    return hits.join(minima, "hash").select("id", "text_hash", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, filter_bits: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a test item of whose shingles it holds at least ``percent`` hundredths.

    Columns: id and text_hash of the document, item_id, copies (items with the same shingle set; the smallest id
    stands for them), n, shared, containment. Whole texts are read. Null and empty texts and items match nothing; a
    null document id is reported as null; repeated rows are reported once.

    What is sent to all tasks is a filter of ``filter_bits`` bits. Its hits are joined with the items' minima, and only
    the pairs found there with all of an item's shingles.
    """
    index = cut(item_index(items, words, percent, item_id, item_text), "items")
    passed = hash_filter(index.select("hash"), filter_bits)
    widths = sorted(r.width for r in index.select("width").distinct().collect())  # at most ``words`` numbers
    schema = StructType([docs.select(F.col(id_col).alias("id")).schema[0]]).add("text_hash", LongType()).add("hash", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            rows, hashes = [], []
            for k, text in enumerate(b["text"].to_pylist()):
                w = cache.of(words_in(text)) if text and widths else ()
                for width in widths if len(w) else ():
                    each = gram_hashes(w, width)
                    each = np.unique(each[in_filter(passed, filter_bits, each)])
                    if len(each):
                        rows.append(np.full(len(each), k))
                        hashes.append(each.view(np.int64))
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b["id"].take(at), b["text_hash"].take(at), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))], ["id", "text_hash", "hash"])

    hits = cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, schema), "hits")
    asked = candidates(hits, index).join(index.drop("minimum"), "item_id")
    had = hits.select(F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash"), F.col("hash").alias("_hash"))
    met = asked.join(had, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("hash") == F.col("_hash")))
    found = met.groupBy("id", "text_hash", "item_id", "copies", "n").agg(F.count_distinct("hash").alias("shared"))
    return found.where(F.col("shared") * 100 >= F.col("n") * percent).select("id", "text_hash", "item_id", "copies", "n", "shared", (F.col("shared") / F.col("n")).alias("containment"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "copies", F.col("n").cast("long").alias("item_shingles"), "shared", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the documents that hold a test item."""
    bad = contaminated(docs, items, words, percent, id_col=id_col, text_col=text_col).select(F.col("id").alias("_dc_id"), F.col("text_hash").alias("_dc_hash")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_dc_id"]) & (F.xxhash64(docs[text_col]) == bad["_dc_hash"]), "left_anti")
