"""Line dedup: drop lines that many documents share, with DataFrame functions only.

Lines are exploded, normalised and hashed, documents are counted per hash, and each document
is put together again, by position, from the lines that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import BLANKS, LOWER, UPPER, cut, table


def line_key(line: Column) -> Column:
    """A line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashed(line: Column, min_chars: int) -> Column:
    """128 bits of the key; null where the key is too short to count."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``text`` less its common lines, and n_lines, n_dropped.

    A line goes, in every document, if its key has at least ``min_chars`` code points and at
    least ``min_docs`` documents hold it. Null and empty texts are one empty line; a document that
    loses all lines keeps an empty text. Rows with one id are one document, however many there are; a null
    id is an id like any other. Input columns named n_lines or n_dropped are replaced; all others pass through.

    The counts are summed before their shuffle. A line that a third of the documents hold
    meets its count in a join of two shuffled sides, which Spark splits when it is skewed; only
    hashes and positions take part, and texts are shuffled once.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    base = docs.drop("n_lines", "n_dropped")
    keys = F.transform(lines, lambda x: _hashed(x, min_chars))
    row = [F.col(id_col).alias("_ld_id"), F.xxhash64(text_col).alias("_ld_text")]

    several = cut(base.groupBy(F.struct(id_col).alias("_ld_doc")).agg(F.count("*").alias("_ld_n")).where("_ld_n > 1").select("_ld_doc"), "ids-of-several-rows")
    if several.isEmpty():
        held = base.select(F.explode(F.array_distinct(keys)).alias("k")).where("k is not null").groupBy("k.a", "k.b").agg(F.count("*").alias("n"))
    else:  # rows of an id of several are counted by that id
        named = base.withColumn("_ld_row", F.struct(id_col)).join(several.withColumn("_ld_again", F.lit(True)), F.col("_ld_row") == F.col("_ld_doc"), "left")
        each = named.select("_ld_doc", F.explode(F.array_distinct(keys)).alias("k")).where("k is not null")
        held = each.groupBy("k.a", "k.b").agg((F.count_if(F.col("_ld_doc").isNull()) + F.count_distinct("_ld_doc")).alias("n"))
    common = cut(held.where(F.col("n") >= min_docs).select("a", "b"), "common-lines")
    at = base.select(*row, F.posexplode(keys).alias("pos", "k")).where("k is not null").select("_ld_id", "_ld_text", "pos", "k.a", "k.b")
    drops = at.join(common, ["a", "b"]).groupBy("_ld_id", "_ld_text").agg(F.collect_set("pos").alias("_ld_drop"))

    whole = base.withColumns({"_ld_key": F.col(id_col), "_ld_hash": F.xxhash64(text_col)})
    joined = whole.join(drops, F.col("_ld_key").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_hash") == F.col("_ld_text")), "left")
    n, gone = F.size(lines), F.col("_ld_drop")
    # as one element of an array, lines and places are worked out once a row and not once a line
    both = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), n - 1), gone).alias("stay")))
    rest = F.transform(both, lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["lines"], i)), "\n"))
    kept = F.when(gone.isNull(), F.array_join(lines, "\n")).otherwise(F.get(rest, F.lit(0)))
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in base.columns],
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS k
  FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id
"""
