import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from barograph.llm import url_filter as U


def brute(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(r, v) for r, v in U.OP5_RULES if (host == (at := r.split("/", 1)[0]) or host.endswith("." + at)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


URLS = ["http://A.Example.ORG/es/1?x=/en", "https://example.org/en/12", "https://example.org", "ftp://x.com/de/", "http://xcom/de/", "http://a.com/fr/#://b.org/", "no scheme", "", None, "x://", "a://É.ORG/É?q", "://org/", "http://org/a://b.com/de/", "http://notexample.org/es/"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    none = U.mine_rules(spark.createDataFrame([], "url string, label boolean"))
    got = {r.page_id: r for r in U.judge_urls(df, U.OP5_RULES, none).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u


def test_mined_rules_are_those_of_brute_force(spark):
    rows = [(f"http://{h}.net/{s}/{i}", h == "bad" and s == "ads") for i in range(8) for h in ("bad", "ok") for s in ("ads", "news")] * 2 + [(None, True), ("http://bad.net/ads/1", None)]
    df = spark.createDataFrame(rows, "url string, label boolean")
    mined = U.mine_rules(df, 0.1, 0.9).collect()
    sets = [(frozenset(r.t), y) for (u, y), r in zip(rows, df.select(U.url_tokens(df.url).alias("t")).collect(), strict=True) if u and y is not None]
    items = {t for s, _ in sets for t in s}
    want = {}
    for n in range(1, 7):
        for c in combinations(sorted(items), n):
            has = [y for s, y in sets if s.issuperset(c)]
            if has and sum(has) >= 0.1 * len(sets) and sum(has) / len(has) >= 0.9:
                want[c] = sum(has) / len(has)
    assert {tuple(r.antecedent): r.confidence for r in mined} == want and want
    judged = {r.url: r.verdict for r in U.judge_urls(df, [], U.mine_rules(df, 0.1, 0.9)).collect()}
    assert judged["http://bad.net/ads/3"] == "block" and judged["http://ok.net/ads/3"] == "allow" and judged[None] == "allow"


def test_query(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = U.op5_url_filter(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def brute_blocked(labelled, urls, confidence=0.5):
    """URLs with a set of tokens that MIN_COUNT blocked URLs have, at the confidence and the base rate or more."""
    total, blocked = len(labelled), {k for k, (_, y) in enumerate(labelled) if y}
    rows = {}
    for k, (tokens, _) in enumerate(labelled):
        for t in tokens:
            rows.setdefault(t, set()).add(k)
    rows = {t: frozenset(x) for t, x in rows.items() if len(x) < total}
    out = set()
    for url, tokens in urls.items():
        have = set()
        for one in {rows[t] for t in tokens if t in rows}:
            have |= {one} | {one & x for x in have}
        if any(len(x & blocked) >= U.MIN_COUNT and len(x & blocked) / len(x) >= max(confidence, len(blocked) / total) for x in have):
            out.add(url)
    return out


def test_op5_mines_rare_hosts_and_long_urls_as_brute_force_does(spark, tmp_path):
    rng = random.Random(5)
    urls = [f"http://{rng.choice('abcdefgh')}.site{rng.randrange(12)}.info/{rng.choice(['x', 'y', 'z'])}/{n}" + rng.choice(["", "?k=1", "?k=1&j=2", ".html"]) for n in range(1200)]
    bad = {n: rng.random() < 0.2 for n in range(1200)}
    many = "&".join(f"q{k}={k}" for k in range(70))
    deep = ".".join(f"d{k}" for k in range(80))
    for n in range(6):
        urls[n], bad[n] = f"http://rare.info/p{n}/{n}", True
        urls[10 + n], bad[10 + n] = f"http://shop{n}.info/find/{10 + n}?{many}", True
        urls[20 + n], bad[20 + n] = f"http://{deep}.s{n}.info/{20 + n}", True
    urls += ["http://rare.info/new", "http://shop.info/other?q69=1", "http://d79.info/", "http://fine.info/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(n, 1, int(y)) for n, y in bad.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tokens = {r.url: set(r.t) for r in spark.createDataFrame([(u,) for u in urls], "url string").select("url", U.url_tokens(F.col("url")).alias("t")).collect()}
    want = brute_blocked([(tokens[urls[n]], bad[n]) for n in range(1200)], tokens)
    got = {r.url for r in U.op5_url_filter(spark, str(tmp_path)).join(spark.read.parquet(f"{tmp_path}/pages.parquet"), "page_id").where("rule IS NULL AND verdict = 'block'").collect()}
    assert got == want and {"http://rare.info/new", "http://shop.info/other?q69=1", "http://d79.info/"} <= got and "http://fine.info/" not in got


def test_the_last_number_names_the_document(spark):
    urls = {"https://a/2020/01/5.html": "5", "https://a/en/17": "17", "https://a/3/x": "3", "https://a/x9": "", "https://a/": "", "a/7": "", None: "", "https://a/1?p=/2": "1", "https://a/1/22/#/3": "22"}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", U.page_number(F.col("url")).alias("n")).collect()
    assert {r.url: r.n for r in rows} == urls


def test_empty_tables_repeats_and_common_tokens(spark):
    rows = [(f"http://site.net/{s}/{k}", s == "ads" or k % 4 == 0) for s in ("ads", "ads", "news") for k in range(20)]
    mined = U.mine_rules(spark.createDataFrame(rows, "url string, label boolean"))
    pages = spark.createDataFrame([(1, rows[0][0]), (1, rows[0][0]), (2, rows[-1][0]), (3, None), (4, "http://site.net/ads/" + "9" * 50_000)], "page_id long, url string")
    got = sorted((r.page_id, r.verdict) for r in U.judge_urls(pages, [], mined).collect())
    assert got == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "block")]  # two thirds of the URLs have path:ads
    assert U.judge_urls(pages.limit(0), U.OP5_RULES, mined).count() == 0
    assert U.page_number(F.lit("http://a/x/1234567890123456789012345")) is not None
