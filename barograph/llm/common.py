"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 26 letters that contracts lower-case; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the word and line rules: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\f\r"
#: Entries that a task's word cache holds before it starts afresh.
CACHE_WORDS = 1_000_000
#: Spark's setting that removes shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folder of this process where none is named.
_own: list[str] = []
#: Odd multipliers and mixers of the 64-bit hashes (fixed values).
MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one that was set for checkpoints.

    Where the session names none and all runs on one machine (tests), a temporary folder of this process is taken; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="barograph-"))
    return _own[0]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/barograph-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage of ``df``: write it in the shared folder and read it again.

    The files outlive a lost executor, and a plan that reads them twice computes once. Shuffle files of the write go
    when it is done, since nothing reads them any more; else they stay until the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``cut`` has written and nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def hash_filter(hashes: DataFrame, bits: int, column: str = "hash") -> np.ndarray:
    """A one-hash Bloom filter of ``bits`` (a power of two) bits over a LONG column, as packed bytes.

    Spark builds it in pieces of 4 KB; the driver gets ``bits / 8`` bytes, however many hashes there are. A fuller
    filter lets more through and misses nothing.
    """
    slot = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("part")).collect()
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in rows:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.part), np.uint8)
    return out


def in_filter(packed: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """For each hash (uint64) whether the filter may hold it."""
    slot = hashes & np.uint64(bits - 1)
    return (packed[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * MIX_B
    h = (h ^ (h >> np.uint64(27))) * MIX_C
    return h ^ (h >> np.uint64(31))


#: Bytes of a text whose words are hashed at once, and the longest word that is hashed so.
STRETCH, LONG_WORD = 1 << 16, 64
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_A)
_POWER = np.full(STRETCH + LONG_WORD, MIX_A).cumprod()
_INVERSE = np.full(STRETCH + LONG_WORD, pow(int(MIX_A), -1, 1 << 64), np.uint64).cumprod()


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of each run of other bytes than \\x20 and \\x09-\\x0D.

    A word is a polynomial in its bytes: a difference of running sums over the text, put back to power 0.
    Longer words than LONG_WORD are hashed one by one.
    """
    text = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(text) + 2, bool)
    np.take(_BLANK, text, out=blank[1:-1], mode="clip")
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, stops = edge[::2], edge[1::2]
    out, long = np.empty(len(starts), np.uint64), stops - starts > LONG_WORD
    # stretches of short words, so that the tables of powers are long enough
    part = starts // STRETCH + np.cumsum(long) * 2
    part[long] -= 1
    bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(starts)] if len(starts) else [0]
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        if long[i]:
            for k in range(i, j):
                out[k] = xxhash.xxh64_intdigest(raw[starts[k] : stops[k]])
            continue
        low, n = starts[i], stops[j - 1] - starts[i]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE.take(text[low : low + n], mode="clip") * _POWER[:n], out=sums[1:])
        out[i:j] = (sums[stops[i:j] - low] - sums[starts[i:j] - low]) * _INVERSE[starts[i:j] - low]
    return mixed(out)


def text_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """Hashes of the words of a text; ``lower`` lower-cases A-Z."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return word_hashes(raw.lower() if lower else raw)


class WordHashes(dict):
    """64-bit hash of a word; remembers up to CACHE_WORDS words."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of other bytes than \\x20 and \\x09-\\x0D, as UTF-8; ``lower`` lower-cases A-Z."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring word hashes: their polynomial behind ``n``, of which each step doubles the run."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h, have = words, 1
    for bit in bin(n)[3:]:
        h = h[:-have] * np.uint64(pow(int(MIX_A), have, 1 << 64)) + h[have:]
        have *= 2
        if bit == "1":
            h = h[:-1] * MIX_A + words[have:]
            have += 1
    return mixed(h + np.uint64(n * pow(int(MIX_A), n, 1 << 64) % (1 << 64)))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingle hashes; fewer words make one shingle, none an empty set."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, min(n, len(words))))
