"""Near-duplicates by b-bit min-hash.

Shingle sets get minima under ``bands * rows`` hash functions. Bands of minima bring candidates
together; only the two low bits of each minimum are kept, packed into longs, and bit counts of two signatures
estimate their similarity, corrected for chance collisions. What passes is confirmed on the full sets.

A bucket's members are compared with leads and not pair by pair. What the leads leave apart is settled by the shingles that
members have in common with other components: where those are too few, no link is possible, and the rest is paired by its
rarest ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, LongType, StructType

from barograph.llm.common import MIX_A, cut, mixed, shingles, table, text_hashes
from barograph.llm.components import connected_components

#: Shingles hashed at a time under all functions, which bounds a task's memory.
BLOCK = 4096


@dataclass(frozen=True)
class NearDup:
    """``percent``: least similarity in hundredths. A pair at it is missed by all bands with probability ``miss``."""

    words: int = 5
    percent: int = 80
    rows: int = 6
    miss: float = 1e-6
    seed: int = 1

    @property
    def bands(self) -> int:
        return max(1, math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))) if self.percent < 100 else 1

    @property
    def longs(self) -> int:
        return -(-self.bands * self.rows // 64)

    def signer(self):
        """Function of a shingle set: (packed low bits, band hashes)."""
        draw, k = np.random.default_rng(self.seed), self.bands * self.rows
        flip = draw.integers(0, 1 << 32, (k, 1), np.uint32)
        times = draw.integers(0, 1 << 31, (k, 1), np.uint32) * np.uint32(2) + np.uint32(1)

        def sign(each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            low, least = (each >> np.uint64(32)).astype(np.uint32), np.full(k, 0xFFFFFFFF, np.uint32)
            for at in range(0, len(low), BLOCK):
                h = low[None, at : at + BLOCK] ^ flip
                h *= times
                np.minimum(least, h.min(1), out=least)
            bits = np.zeros((2, self.longs * 64), np.uint8)
            bits[0, :k], bits[1, :k] = least & 1, least >> 1 & 1
            planes = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
            code = np.arange(self.bands, dtype=np.uint64)  # equal minima in different bands are different buckets
            for j in range(self.rows):
                code = mixed(code * MIX_A + least[j :: self.rows].astype(np.uint64))
            return planes, code.view(np.int64)

        return sign

    def estimate(self, p: Column, q: Column) -> Column:
        """Similarity of two signatures: equal pairs of low bits, less those equal by chance."""
        k, n = self.bands * self.rows, self.longs
        differ = sum((F.bit_count(p[i].bitwiseXOR(q[i]).bitwiseOR(p[n + i].bitwiseXOR(q[n + i]))) for i in range(1, n)), F.bit_count(p[0].bitwiseXOR(q[0]).bitwiseOR(p[n].bitwiseXOR(q[n]))))
        return ((k - differ) / k - 0.25) / 0.75

    @property
    def least_estimate(self) -> float:
        """Six standard errors under the threshold."""
        t, k = self.percent / 100, self.bands * self.rows
        p = t + (1 - t) / 4
        return t - 6 * math.sqrt(max(p * (1 - p), 1e-9) / k) / 0.75


def sketches(docs: DataFrame, how: NearDup, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, th (hash of the text), n (set size), set (128 bits that stand for the set), planes, bands."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    schema = StructType(rows.schema.fields[:2]).add("n", "long").add("set", "binary").add("planes", ArrayType(LongType())).add("bands", ArrayType(LongType()))
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = how.signer()
        for b in batches:
            n, key, planes, bands = [], [], [], []
            for text in b["text"].to_pylist():
                each = shingles(text_hashes(text, lower=True), how.words)
                n.append(len(each))
                key.append(xxhash.xxh3_128_digest(each.tobytes()) if len(each) else None)
                p, q = sign(each) if len(each) else (None, None)
                planes.append(p)
                bands.append(q)
            yield pa.RecordBatch.from_arrays([b["id"], b["th"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(planes, longs), pa.array(bands, longs)], ["id", "th", "n", "set", "planes", "bands"])

    return rows.mapInArrow(run, schema)


def classes_of(made: DataFrame) -> DataFrame:
    """A row for each distinct set: node, set, id and th of one of its rows (that of the smallest id), planes, bands.

    ``node`` is the id where the id is a whole number and has one set only, or else a 64-bit hash of id and set.
    """
    named = made.where("id is not null and set is not null")
    one = named.groupBy("set").agg(F.min(F.struct("id", "th")).alias("row"), F.first("planes").alias("planes"), F.first("bands").alias("bands")).select("set", "row.*", "planes", "bands")
    other = F.xxhash64("id", "set")
    if not isinstance(made.schema["id"].dataType, IntegralType):
        return one.withColumn("node", other)
    mark = F.xxhash64("set")
    several = cut(named.groupBy("id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low < high").select(F.col("id").alias("several")), "ids-of-several")
    return one.join(several, F.col("id") == F.col("several"), "left").withColumn("node", F.when(F.col("several").isNull(), F.col("id").cast("long")).otherwise(other)).drop("several")


def compared(pairs: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough; texts: node, text."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("s")), texts.select(F.col("node").alias("b"), F.col("text").alias("t"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            linked = []
            for s, t in zip(batch["s"].to_pylist(), batch["t"].to_pylist(), strict=True):
                sets = []
                for text in (s, t):
                    if text not in known:
                        if len(known) > 64:
                            known.clear()
                        known[text] = shingles(text_hashes(text, lower=True), how.words)
                    sets.append(known[text])
                same = int(np.isin(sets[1], sets[0], assume_unique=True).sum())
                linked.append(100 * same >= how.percent * (len(sets[0]) + len(sets[1]) - same))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def sets_of(nodes: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """``nodes`` (node, component) with n and tokens, the hashes of the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [shingles(text_hashes(t, lower=True), how.words).view(np.int64) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["node"], b["component"], pa.array([len(x) for x in each], pa.int64()), pa.array(each, pa.list_(pa.int64()))], ["node", "component", "n", "tokens"])

    return nodes.join(texts, "node").select("node", "component", "text").mapInArrow(run, "node long, component long, n long, tokens array<long>")


def still_open(sets: DataFrame, how: NearDup) -> DataFrame:
    """``sets`` less the tokens that no other component has, and less the sets that can't be linked without them.

    A set of ``n`` tokens, of which other components have ``o``, shares at most ``o`` with any set of those. So a set of
    size ``m`` can be linked with it only if ``(n + m) p / (100 + p) <= o``, and ``m`` is ``p n / 100`` at least.
    """
    p = how.percent
    each = sets.select("node", "component", "n", F.explode("tokens").alias("token"))
    outside = each.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    left = each.join(outside, "token").groupBy("node", "component", "n").agg(F.collect_list("token").alias("tokens"))
    o = F.size("tokens").cast("long")
    return left.where(F.floor(o * (100 + p) / F.lit(p)) - F.col("n") >= F.ceil(F.col("n") * p / F.lit(100)))


def rare_pairs(sets: DataFrame, how: NearDup) -> DataFrame:
    """Pairs (a, b) of sets of different components that may be linked, by the prefix principle.

    Tokens are put in one order, rarest first. Two sets that share ``need`` tokens have their first common one where at
    least ``need`` tokens are left in both, itself included. The larger set must share ``p n / 100`` with any, and
    the smaller one of ``m`` tokens ``2 p m / (100 + p)`` with any that is no smaller; only such beginnings are joined.
    """
    p = how.percent
    each = sets.select("node", "component", "n", F.explode("tokens").alias("token"))
    found = each.join(each.groupBy("token").agg(F.count("*").alias("df")), "token").groupBy("node", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    placed = found.select("node", "component", "n", F.size("tokens").cast("long").alias("o"), F.posexplode("tokens.token").alias("place", "token"))
    side = lambda s, least: placed.where(F.col("o") - F.col("place") >= F.ceil(least)).select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "component", "n")], (F.col("o") - F.col("place")).alias(f"{s}_left"))
    x, y = side("x", F.col("n") * p / F.lit(100)), side("y", F.col("n") * (2 * p) / F.lit(100 + p))
    order = (F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") > F.col("y_node")))
    need = F.ceil((F.col("x_n") + F.col("y_n")) * p / F.lit(100 + p))
    fits = order & (F.col("x_component") != F.col("y_component")) & (F.col("y_n") * 100 >= F.col("x_n") * p) & (F.least("x_left", "y_left") >= need)
    return x.join(y, "token").where(fits).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def linked_nodes(members: DataFrame, signs: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """node and component of the nodes that are linked with another; members: bucket, node, size (of the bucket)."""

    def likely(pairs: DataFrame) -> DataFrame:
        p = pairs.join(signs.select(F.col("node").alias("a"), F.col("planes").alias("p")), "a").join(signs.select(F.col("node").alias("b"), F.col("planes").alias("q")), "b")
        return p.where(how.estimate(F.col("p"), F.col("q")) >= how.least_estimate).select(*pairs.columns)

    def named(found: DataFrame, column: str, to: str) -> DataFrame:
        return found.select(F.col("id").alias(column), F.col("component").alias(to))

    weights = members.groupBy("node").agg((-F.sum("size")).alias("w"))
    members = cut(members.join(weights, "node").select("bucket", "node", "w"), "weighed")
    heaviest = F.min(F.struct("w", "node")).alias("lead")
    leads = cut(members.groupBy("bucket").agg(heaviest).select("bucket", "lead.*"), "leads")
    star = lambda rows, of: rows.join(of.select("bucket", F.col("node").alias("a"), F.col("w").alias("a_w")), "bucket").where("node <> a").select("a", F.col("node").alias("b"), "a_w").distinct()

    # each member with one of its leads, and then with those that are in another component
    stars = cut(star(members, leads), "stars")
    tried = cut(likely(stars).groupBy("b").agg(F.min_by("a", F.struct("a_w", "a")).alias("a")).select("a", "b"), "tried")
    links = cut(compared(tried, texts, how), "links")
    # a member that is linked with a lead goes by that one's lead: names that are quick to make, if not yet whole components
    first = links.select(F.col("b").alias("id"), F.col("a").alias("component"))
    found = cut(first.join(first.select(F.col("id").alias("component"), F.col("component").alias("next")), "component", "left").select("id", F.coalesce("next", "component").alias("component")), "names")
    apart = lambda pairs: pairs.join(named(found, "a", "of_a"), "a", "left").join(named(found, "b", "of_b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    more = cut(compared(likely(apart(stars.join(tried, ["a", "b"], "left_anti"))), texts, how), "links")
    links = links.union(more)
    found = connected_components(links)

    # in buckets that hold several components, new leads for the components that had none, as long as that links any
    while True:
        placed = members.join(named(found, "node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
        placed = cut(placed.join(split, "bucket", "left_semi"), "split-buckets")
        led = leads.join(placed.select("bucket", "node", "component"), ["bucket", "node"]).select("bucket", "component").distinct()
        rest = cut(placed.join(led, ["bucket", "component"], "left_anti"), "not-led")
        chosen = cut(rest.groupBy("bucket").agg(heaviest).select("bucket", "lead.*"), "new-leads")
        more = cut(compared(likely(apart(star(rest, chosen))), texts, how), "links")
        if more.isEmpty():
            break
        members, leads, links = placed.drop("component"), leads.union(chosen), links.union(more)
        found = connected_components(links)

    sets = cut(sets_of(placed.select("node", "component").distinct(), texts, how), "open-sets")
    n = sets.count()
    while n:
        sets = cut(still_open(sets, how), "open-sets")
        n, before = sets.count(), n
        if n > 0.9 * before:
            break
    last = cut(compared(likely(rare_pairs(sets, how)), texts, how), "links")
    return connected_components(links.union(last)) if n and not last.isEmpty() else found


def judged(docs: DataFrame, how: NearDup, id_col: str, text_col: str) -> DataFrame:
    """id, th, n, component (the smallest id of the group; null for a null id) and kept of each row of ``docs``."""
    made = cut(sketches(docs, how, id_col, text_col), "sketches")
    classes = cut(classes_of(made), "classes")
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    shared = cut(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = cut(rows.join(shared, "bucket"), "members")  # of buckets with two classes at least
    asked = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("id").alias("_id"), F.col("th").alias("_th"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).join(asked, (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th")))
    texts = cut(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    groups = linked_nodes(members, classes.select("node", "planes"), texts, how)
    of_node = groups.select(F.col("id").alias("node"), "component").join(classes.select("node", "set", "id"), "node")
    least = of_node.groupBy("component").agg(F.min("id").alias("least"))
    of_set = classes.select("set", "id").join(of_node.join(least, "component").select("set", "least"), "set", "left").select("set", F.coalesce("least", "id").alias("component"))
    whole = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return made.select("id", "th", "n", "set").join(of_set, "set", "left").select("id", "th", "n", whole.alias("component"), F.coalesce(F.col("id") == whole, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, how: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (the smallest id of its group) and kept.

    Two texts are in one group if a chain of pairs that are confirmed on full sets joins them. Null and empty
    texts, and texts of blanks, have no shingles and are linked with nothing. A null id is linked with nothing: it is
    its own group (component_id null) and kept. Rows that repeat an id are judged by their own texts, and those of
    them that are in one group stay or go together.

    Equal sets are one class, of which one row takes part in the search. In each bucket one member leads: that which shares
    most buckets with most others. First each member is compared with one of its leads, then with those in
    other components, and then with new leads of components that had none. A link between what is then still apart is
    searched among the sets that can have one, by their tokens (still_open, rare_pairs). So a group of near copies costs
    comparisons in proportion to its size, and no link that would join two components is lost.
    """
    out = judged(docs, how, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDup(words=3, percent=85))


def drop_near_duplicates(docs: DataFrame, how: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less all but one document, that of the smallest id, of each group of near-duplicates."""
    gone = judged(docs, how, id_col, text_col).where("not kept").select(F.col("id").alias("_nd_id"), F.col("th").alias("_nd_th"))
    return docs.join(gone, (docs[id_col] == gone["_nd_id"]) & (F.xxhash64(docs[text_col]) == gone["_nd_th"]), "left_anti")
