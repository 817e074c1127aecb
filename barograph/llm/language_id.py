"""Language ID by rank-order profiles.

A language's profile is its most frequent letter n-grams in rank order. A document is given
the language whose profile its own most frequent n-grams are least out of place in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barograph.llm.common import table

#: Label of a text without letters, or where nothing was learned.
UNKNOWN = "und"
#: Code points of a text that are counted at a time, so that very long texts need no more memory.
BLOCK = 1 << 20
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point whether it is a letter (general category L); made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1-, 2- and 3-grams of the lower-cased words of a whole text, and their counts.

    Words are runs of letters with a blank on both sides; no gram crosses words. A gram is an
    integer of 21 bits a character.
    """
    codes, counts = [], []
    letter, text = is_letter(), f" {text.lower()} "
    for start in range(0, len(text), BLOCK):
        a = np.frombuffer(text[start : start + BLOCK + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        a = np.where(letter[a], a, 32)
        word, n = a != 32, min(BLOCK, len(text) - start)  # the two characters more only end grams
        two, three = a[:-1] << 21 | a[1:], a[:-2] << 42 | a[1:-1] << 21 | a[2:]
        c, k = np.unique(np.concatenate((a[:n][word[:n]], two[:n][(word[:-1] | word[1:])[:n]], three[:n][word[1:-1][:n]])), return_counts=True)
        codes.append(c)
        counts.append(k)
    if len(codes) == 1:
        return codes[0], counts[0]
    c, at = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent grams, most frequent first; of equals the smaller code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def learn(docs: DataFrame, size: int = 300, sample_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Profiles of the languages of ``docs``: their ``size`` most frequent grams in order.

    Learns every label, from a bounded sample of its rows: about ``sample_docs`` documents, chosen by a
    hash of the id. Rows without text or label are left out. What reaches the driver is ``size`` grams
    a language, and all tasks get the number of rows of each label.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    share = rows.groupBy("lang").agg((sample_docs / F.count("*")).alias("share"))
    taken = rows.where("text is not null").join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict[str, list] = {}
            for t, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                of.setdefault(lang, []).append(gram_counts(t))
            for lang, each in of.items():
                codes, at = np.unique(np.concatenate([c for c, _ in each]), return_inverse=True)
                n = np.bincount(at, np.concatenate([k for _, k in each])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

    grams = taken.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = grams.withColumn("place", place).where(F.col("place") <= size).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "gram"))).alias("best"))
    return {r.lang: np.array(r.grams, np.int64) for r in best.select("lang", F.col("best.gram").alias("grams")).orderBy("lang").collect()}


class Judge:
    """Out-of-place distance of texts to each profile."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.langs, self.size = sorted(profiles), size
        each = [profiles[x] for x in self.langs]
        grams = np.concatenate(each) if each else np.zeros(0, np.int64)
        order = np.argsort(grams, kind="stable")
        # a row for each gram of each profile, so that memory grows with the profiles only
        self.grams = grams[order]
        self.lang = np.repeat(np.arange(len(each)), [len(x) for x in each])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in each])[order] if each else grams

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 if the text's ranks are the profile's, 0 if no gram of it is there."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        codes, counts = gram_counts(text)
        top = ranked(codes, counts, self.size)
        if not len(top):
            return UNKNOWN, 0.0
        first = np.searchsorted(self.grams, top)
        n = np.searchsorted(self.grams, top, "right") - first
        at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        near = np.maximum(0, self.size - np.abs(self.place[at] - np.repeat(np.arange(len(top)), n)))
        out = self.size * len(top) - np.bincount(self.lang[at], near, len(self.langs))
        best = int(np.argmin(out))  # of equals the first by name
        return self.langs[best], 1.0 - float(out[best]) / (self.size * len(top))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 300, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text and a score of 0 to 1.

    ``und`` with score 0 for null texts, texts without a letter, and all texts if there are no
    profiles. Of languages at equal distance the first by name is taken. Input columns named as
    the two new ones are replaced; all others pass through.
    """
    kept = docs.drop(pred_col, score_col)
    schema = StructType([*kept.schema.fields]).add(pred_col, "string").add(score_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, size)
        for b in batches:
            said = [judge.judge(t) for t in b[text_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], [*b.schema.names, pred_col, score_col])

    return kept.mapInArrow(run, schema)


def training_fold(docs: DataFrame) -> DataFrame:
    """Documents whose crc32 of the id's text, mod 5, isn't 0; a null id is not held out."""
    return docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(1)) != 0)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(training_fold(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).drop("text")


def reject_unknown(docs: DataFrame) -> DataFrame:
    """Documents less those whose language cannot be told.

    These are null texts, texts without a letter, and texts at the greatest distance from all profiles (score 0):
    no gram of theirs is where a profile has it, as in a script that was never learned.
    """
    said = identify(docs, learn(training_fold(docs)), pred_col="_li_lang", score_col="_li_score")
    return said.where((F.col("_li_lang") != UNKNOWN) & (F.col("_li_score") > 0)).select(*docs.columns)
