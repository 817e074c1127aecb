"""URL filters: explicit host and path rules, and association rules that Spark's FP-growth mines.

DataFrame and SQL functions only. Token combinations of labelled URLs that go with the label
are mined by FP-growth, pruned by support and confidence, and matched through an inverted
index on each rule's rarest token.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import LOWER, UPPER, cut, table

#: The item that stands for the label in a transaction; no URL token has this form.
LABEL = "#block"
#: Labelled URLs that a rule of op5 needs (its tokens and the label together); doesn't grow with the corpus.
MIN_COUNT = 5
#: Rules of the op5 contract (fixed values): host and path, verdict.
OP5_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased, and then up to ``? #``.

    Both are empty if the url is null or has no ``://``.
    """
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (``host/path``) whose host is the url's or a parent of it and whose path starts the url's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        at, start = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: its host, host labels, path segments and query keys; none for null."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    named = lambda kind, parts: F.transform(parts, lambda x: F.concat(F.lit(kind), x))
    labels = F.split(host, r"\.")
    tokens = F.concat(named("host:", F.array(host)), named("label:", labels), named("path:", F.split(path, r"[/.]+")), named("key:", F.regexp_extract_all(query, F.lit(r"([^&=]+)(?:=[^&]*)?"), 1)))
    return F.array_distinct(F.filter(tokens, lambda x: ~x.rlike(r"^[a-z]+:$")))


def mine_rules(labelled: DataFrame, min_support: float | None = None, min_confidence: float = 0.5, url_col: str = "url", label_col: str = "label") -> DataFrame:
    """Association rules ``tokens -> label`` of ``labelled`` (url, label boolean): antecedent, classes, confidence, support, anchors.

    With a ``min_support`` (share of the labelled URLs) all rules are returned. Without one a rule needs MIN_COUNT
    URLs that have its tokens and the label, however many URLs there are; tokens that occur in just the same URLs are
    then mined as one class, and a rule fits a URL that has a token of each of its ``classes``: just the URLs that the rules
    with all choices of tokens fit, and a long URL makes no power set. ``antecedent`` has the first token of each class. A rule's
    confidence is at least ``min_confidence`` and the labelled URLs' own rate.

    Tokens that all labelled URLs have are then left out, since a rule with them says what it says without. ``anchors`` is the
    rarest class. Repeated rows count each; null urls or labels are left out; with no labelled rows there are no rules.
    """
    told = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
    rows = cut(told.select(F.monotonically_increasing_id().alias("id"), url_tokens(F.col(url_col)).alias("tokens"), F.col(label_col).cast("boolean").alias("label")), "labelled-urls")
    total, blocked = rows.agg(F.count("*"), F.count_if("label")).first()
    schema = "antecedent array<string>, classes array<array<string>>, confidence double, support double, anchors array<string>"
    least = MIN_COUNT if min_support is None else min_support * total
    if not total or least > total:
        return labelled.sparkSession.createDataFrame([], schema)
    each = rows.select("id", F.explode("tokens").alias("token"))
    # Two 64-bit hashes of the set of URLs that have the token.
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    counts = each.groupBy("token").agg(F.count("*").alias("df"), *marks).where((F.col("df") < total + (min_support is not None)) & (F.col("df") >= math.floor(least)))
    alike = ["df", "mark1", "mark2"] + (["token"] if min_support is not None else [])
    named = cut(counts.withColumn("own", F.col("token")).groupBy(*alike).agg(F.min("own").alias("item"), F.collect_list("own").alias("alike")), "url-items")
    items = each.join(named.select("item", F.explode("alike").alias("token")), "token").groupBy("id").agg(F.collect_set("item").alias("items"))
    labels = F.when(F.col("label"), F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))
    baskets = rows.select("id", labels.alias("said")).join(items, "id", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), "said").alias("items"))
    # FPGrowth rounds support * total up: half a row less meets the count whatever the rounding.
    model = FPGrowth(itemsCol="items", minSupport=(MIN_COUNT - 0.5) / total if min_support is None else min_support, minConfidence=max(min_confidence, blocked / total)).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(LABEL))).select("antecedent", "confidence", "support")
    ranked = rules.select("*", F.explode("antecedent").alias("item")).join(named.select("item", "df", "alike"), "item")
    sets = ranked.groupBy("antecedent", "confidence", "support").agg(F.array_sort(F.collect_list(F.struct("df", "alike"))).alias("sets"))
    classes = F.col("sets.alike")  # the rarest first
    return sets.select(F.array_sort(F.transform(classes, lambda c: F.array_min(c))).alias("antecedent"), classes.alias("classes"), "confidence", "support", F.get(classes, F.lit(0)).alias("anchors"))


def matches(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct urls that some rule fits: one column, ``url_col``.

    A url meets only the rules of whose rarest class it has a token; the other classes are then checked.
    """
    each = urls.select(url_col).where(F.col(url_col).isNotNull()).distinct().select(url_col, url_tokens(F.col(url_col)).alias("tokens"))
    met = each.select(url_col, "tokens", F.explode("tokens").alias("anchor")).join(rules.select(F.explode("anchors").alias("anchor"), "classes"), "anchor")
    return met.where(F.forall("classes", lambda c: F.arrays_overlap(c, F.col("tokens")))).select(url_col).distinct()


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict: the rule's, or else block where a mined rule fits, or else allow.

    A null url has no rule and is allowed. Repeated rows are judged alike, an empty table gives no rows, and the length of a url
    doesn't matter. Input columns with these names are replaced.
    """
    hit = matches(pages, mined, url_col).select(F.col(url_col).alias("_uf_url"), F.lit(True).alias("_uf_hit"))
    host, path = host_and_path(F.col(url_col))
    judged = pages.drop("host", "path", "rule", "verdict").join(hit, F.col(url_col) == F.col("_uf_url"), "left")
    judged = judged.withColumns({"host": host, "path": path}).withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    said = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules]) if rules else F.lit(None).cast("string")
    verdict = F.coalesce(said, F.when(F.col("_uf_hit"), F.lit("block")), F.lit("allow"))
    return judged.withColumn("verdict", verdict).drop("_uf_url", "_uf_hit")


def page_number(url: Column) -> Column:
    """The last of the path's parts that is a number, an extension behind it or not; empty if there is none."""
    return F.regexp_extract(host_and_path(url)[1], r"^(?s:.*)/(\d+)(?:[/.](?s:.*))?$", 1)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A url's last number names the document that the page shows; that document's label is the page's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("label"))
    numbered = pages.select("url", page_number(F.col("url")).alias("n"))
    labelled = numbered.where("n <> ''").select("url", F.col("n").try_cast("long").alias("doc_id")).join(labels, "doc_id")
    return judge_urls(pages, OP5_RULES, mine_rules(labelled)).select("page_id", "host", "path", "rule", "verdict")
