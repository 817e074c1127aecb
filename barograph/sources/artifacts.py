"""Immutable results, named by the SHA-256 of their content."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes at either end of a file that its fingerprint reads.
ENDS = 1 << 20


def content_digest(df: DataFrame) -> str:
    """The same for equal rows in any order and partitioning: a sum of row hashes, with schema and count."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    halves = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16, 31, 46)]
    s = df.agg(F.count("*"), *halves).first()
    return hashlib.sha256(json.dumps([df.schema.jsonValue(), [str(x) for x in s]], sort_keys=True).encode()).hexdigest()


class Artifacts:
    """Tables as Parquet and documents as JSON under ``root``, in folders by the digest's first two digits."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path_for(self, digest: str) -> str:
        if not digest or any(c not in "0123456789abcdef" for c in digest):
            raise ValueError(f"{digest!r} is not a digest")
        return f"{self.root}/{digest[:2]}/{digest}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, digest: str) -> bool:
        fs, p = self._fs(self.path_for(digest))
        return fs.exists(p)

    def put_table(self, df: DataFrame) -> str:
        digest = content_digest(df)
        if not self.exists(digest):
            df.write.mode("ignore").parquet(self.path_for(digest))
        return digest

    def get_table(self, digest: str) -> DataFrame:
        return self.spark.read.parquet(self.path_for(digest))

    def put_json(self, document: Any) -> str:
        text = json.dumps(document, sort_keys=True, separators=(",", ":"))
        digest = hashlib.sha256(text.encode()).hexdigest()
        if not self.exists(digest):
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("ignore").option("compression", "gzip").text(self.path_for(digest))
        return digest

    def get_json(self, digest: str) -> Any:
        return json.loads("".join(r.value for r in self.spark.read.text(self.path_for(digest)).collect()))

    def size(self) -> tuple[int, int]:
        """Number of artifacts and their bytes."""
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return 0, 0
        count = sum(len(fs.listStatus(d.getPath())) for d in fs.listStatus(p))
        return count, int(fs.getContentSummary(p).getLength())


def _files(spark: SparkSession, path: str):
    """The file system of a path, and (Hadoop path, bytes) of the file or the files in the folder, by name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f for f in system.listStatus(at) if f.isFile() and f.getPath().getName()[0] not in "_."]
    return system, sorted(((f.getPath(), f.getLen()) for f in found), key=lambda f: f[0].getName())


def fingerprint(spark: SparkSession, path: str) -> str:
    """``fp:`` and a digest of a file's size and its first and last MiB, of which no more is read; of a folder, that of its files' digests by name.

    Of any size; a change that leaves the length and both ends alone isn't seen.
    """
    system, files = _files(spark, path)
    jvm, digests = spark.sparkContext._jvm, []
    for at, size in files:
        stream = system.open(at)
        try:
            n = min(size, ENDS)
            head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
            stream.seek(size - n)
            tail = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()
        digests.append(hashlib.sha256(str(size).encode() + head + tail).hexdigest())
    return f"fp:{digests[0] if len(digests) == 1 else hashlib.sha256(' '.join(digests).encode()).hexdigest()}"


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size, which the JVM reads as a stream."""
    system, files = _files(spark, path)
    stream = system.open(files[0][0])
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
