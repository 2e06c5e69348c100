"""URL filter against plain parts and rules, an exhaustive segmentation, a plain classifier, and on awkward tables."""

import collections
import itertools
import math
import random
import re

from pyspark.sql import functions as F

from cuelattice.llm import queries as llm_queries
from cuelattice.llm import url_filter
from cuelattice.llm.url_filter import Rule, fit_segmenter, fit_url_model, judge_urls, segment, url_parts, word_counts

SF = "/root/testdata/sf0.001"
URLS = [
    None, "", "no scheme", "http://", "://x.net", "HTTP://WWW.Example.COM/De/x", "http://example.com/de/a", "http://a.example.com/de/?q=/fr/", "http://example.net/en/1", "http://x.example.net/en", "http://x.example.net/en/",
    "http://net/", "http://net", "http://subnet/", "http://a.org/fr/x#y", "http://org/fr/", "http://forg/fr/", "http://a.org#/fr/", "a://b.net/c://d.org/fr/", "http://ÄÖ.Net/Ü", "http://a.net\n/x", "http://" + "a" * 3000 + ".net/" + "b" * 5000,
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


def test_parts_and_rules(spark):
    table = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "k int, url string")
    host, path = url_parts(F.col("url"))
    rule = url_filter.fitting_rule(F.col("host"), F.col("path"), llm_queries.URL_RULES)
    for r in table.select("url", host.alias("host"), path.alias("path")).withColumn("rule", rule).collect():
        assert (r.host, r.path) == plain_parts(r.url)
        best = plain_rule(r.host, r.path, llm_queries.URL_RULES)
        assert (r.rule and (r.rule.name, r.rule.verdict)) == (best and (best.host + best.path, best.verdict))


def test_segmentation_is_the_cheapest_of_all():
    costs = {w: c for w, c in (("free", 3.0), ("bets", 3.5), ("bet", 3.2), ("s", 6.0), ("fr", 7.0), ("casino", 4.0), ("win", 2.5))}

    def price(words):
        return sum(costs.get(w, 9.0 + len(w) * math.log(26)) for w in words)

    for name in ("freebets", "casinowin", "winwin", "xqz", "freexbet", "sss"):
        splits = []
        for cuts in itertools.product((0, 1), repeat=len(name) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(name)]
            splits.append([name[a:b] for a, b in itertools.pairwise(at)])
        assert math.isclose(price(segment(name, costs, 9.0)), min(map(price, splits)))
    assert segment("casinowin", costs, 9.0) == ["casino", "win"] and segment("xqz", costs, 9.0) == ["xqz"]
    assert "".join(segment("ab" * 20_000, costs, 9.0)) == "ab" * 20_000


def test_word_counts_leave_tags_out(spark):
    pages = spark.createDataFrame([("<p class='x'>The the&amp;end</p><script>var a</script>",), (None,), ("",)], "html string")
    assert {r.word: r.n for r in word_counts(pages, "html").collect()} == {"the": 2, "end": 1}


def test_query_against_a_plain_classifier(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    words = collections.Counter()
    for p in pages:
        bare = re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>|&\w+;", " ", p.html or "").lower()
        words.update(w for w in re.findall(r"[^\W\d_]+", bare) if len(w) <= url_filter.LONGEST)
    total = sum(words.values())
    costs, unknown = {w: math.log(total / n) for w, n in words.items()}, math.log(total)

    def tokens(host, path):
        return [sign + w for sign, name in (("", host), ("/", path)) for piece in url_filter.PIECE.findall(name) for w in segment(piece.lower(), costs, unknown)]

    split = {p.page_id: tokens(*plain_parts(p.url)) for p in pages}
    bad = {k: bool(set(own) & set(url_filter.UNWANTED)) for k, own in split.items()}
    n = {c: collections.Counter(t for k, own in split.items() if bad[k] == c for t in own) for c in (True, False)}
    size, every = {c: sum(n[c].values()) for c in n}, sum(sum(x.values()) for x in n.values())
    urls = collections.Counter(bad.values())

    def odds(own):
        drawn = {t: (n[True][t] + n[False][t]) / every for t in own}
        return math.log((urls[True] + 1) / (urls[False] + 1)) + sum(
            math.log((n[True][t] + drawn[t]) / (size[True] + 1)) - math.log((n[False][t] + drawn[t]) / (size[False] + 1)) for t in own)

    got = {r.page_id: r for r in llm_queries.op11_url_filter(spark, SF).collect()}
    assert set(got) == set(split)
    for p in pages:
        host, path = plain_parts(p.url)
        rule, own = plain_rule(host, path, llm_queries.URL_RULES), odds(split[p.page_id])
        assert math.isclose(got[p.page_id].block_odds, own, rel_tol=1e-9, abs_tol=1e-9)
        assert got[p.page_id].verdict == (rule.verdict if rule else "block" if own > 0 else "allow")


def test_joined_names_are_found_by_their_words(spark):
    rng = random.Random(2)
    plain = ["river", "garden", "music", "stone", "paper", "light"]
    words = spark.createDataFrame([(w, 50) for w in [*plain, "casino", "win", "free", "bets", "track"]], "word string, n long")
    urls = [(f"{rng.choice(plain)}-{rng.choice(plain)}.example.org", "/en/1") for _ in range(300)] + [("casino-win.example.org", "/en/2")] * 6 + [("free-bets.example.org", "/en/3")] * 6
    model = fit_url_model(spark.createDataFrame(urls, "host string, path string"), fit_segmenter(words))
    asked = {"casinowin": "block", "winfree": "block", "freebets": "block", "riverstone": "allow", "musicpaper": "allow", "light": "allow", "unseenname": "allow"}
    table = spark.createDataFrame([(f"https://{name}.example.org/en/9",) for name in asked], "url string")
    assert {r.host.split(".")[0]: r.verdict for r in judge_urls(table, [], model).collect()} == asked


def test_nulls_long_names_clashing_columns_and_empty_tables(spark):
    words = spark.createDataFrame([("casino", 5)], "word string, n long")
    none = spark.createDataFrame([], "host string, path string")
    model = fit_url_model(none, fit_segmenter(words.limit(0)))
    table = spark.createDataFrame([(k, u, "mine", 1) for k, u in enumerate(URLS)] * 2, "page_id int, url string, VERDICT string, extra int")
    got = judge_urls(table, [Rule("block", "net")], model)
    assert got.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict", "block_odds"]
    rows = got.collect()
    assert len(rows) == 2 * len(URLS) and {r.verdict for r in rows} == {"allow", "block"}
    assert all(r.verdict == "allow" and r.rule is None for r in rows if r.url is None)
    assert judge_urls(table.limit(0), [], model).count() == 0
