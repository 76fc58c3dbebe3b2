import collections
import math
import random

from pyspark.sql import functions as F

from shelfline.llm import url_filter

RULES = url_filter.RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def ruled(url):
    host, path = parts(url)
    best = (None, None)
    for rule, kind in RULES:
        site, _, rest = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + rest) \
                and len(rule) > len(best[0] or ""):
            best = (rule, kind)
    return best


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, host string, label int")
    return url_filter.judged(df).collect()


URLS = ["http://a.example.net/en/1", "http://example.net/en", "HTTPS://WWW.Example.NET/en/x?y", "http://net/", "http://net",
        "http://xnet/", "http://x.org/fr/1#a", "http://org/fr/", "http://x.org/FR/1", "http://a.example.com/de/2",
        "http://badexample.com/de/2", "http://x.com?q=/de/", "x://y://z/", "nothing", "", None, "://", "http://É.net/Ü",
        "http://a.b/" + "c" * 50_000, "http://x.net/\nline", "http://u:p@Host.net:80/de/?a#b?c"]


def test_small_cases(spark):
    rows = [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])]
    out = run(spark, rows)
    assert len(out) == len(rows)
    want = collections.Counter((k, *parts(u), ruled(u)[0]) for k, u in rows)
    assert collections.Counter((r.page_id, r.host, r.path, r.rule) for r in out) == want
    kinds = dict(RULES)
    assert all(r.verdict == kinds[r.rule] if r.rule else r.verdict in ("allow", "block") for r in out)
    assert run(spark, []) == []
    assert {r.verdict for r in run(spark, [(1, "http://a.com/"), (2, None)])} == {"allow"}
    assert {r.verdict for r in run(spark, [(1, "http://a.com/"), (2, "http://a.net/")])} == {"block"}


def test_entropy(spark):
    texts = ["aab", "", "abcdabcd", "zzzz", "http://x.y/ab?c=1"]
    df = spark.createDataFrame([(i, t, "h", "p", 0) for i, t in enumerate(texts)],
                               "i int, url string, host string, path string, label int")
    for r in url_filter.lexical(df).collect():
        n = len(r.url)
        want = -sum(c / n * math.log2(c / n) for c in collections.Counter(r.url).values())
        assert abs(r.entropy - want) < 1e-9


def test_held_out_urls(spark):
    """Labels follow a lexical trait; the trees must judge URLs they have not seen by it."""
    rng = random.Random(1)

    def url(site, blocked):
        tail = "".join(rng.choices("0123456789" if blocked else "abcdefghij", k=rng.randint(8, 30)))
        return f"http://{site}/{'xx' if blocked else 'en'}/{tail}"
    seen = [(i, url("site.example.net", i % 2 == 1)) for i in range(600)]
    new = [(1000 + i, url("other.info", i % 2 == 1)) for i in range(100)]
    out = {r.page_id: r.verdict for r in run(spark, seen + new)}
    assert sum(out[k] == ("block" if k % 2 else "allow") for k, _ in new) >= 90


def test_rare_label_and_repeated_url_in_the_sample(spark):
    """One blocked URL among many allowed ones, and an allowed URL with most rows: both labels are sampled."""
    rows = [(i, f"http://a.example.net/en/{i}") for i in range(60)] + [(100, "http://x.net/1"), (101, "http://new.info/")]
    rows += [(200 + i, "http://a.example.net/en/0") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    data = url_filter.features(
        df.withColumn("host", url_filter.host("url")).withColumn("path", url_filter.path("url"))
        .withColumn("label", F.when(F.col("host") == "x.net", 1).when(F.col("host") == "a.example.net", 0)))
    sample = url_filter.sampled(data, 20).collect()
    assert len({r.url for r in sample}) == len(sample) == 20 and sum(r.label for r in sample) == 1
    weigh = lambda label: sum(r.weight for r in sample if r.label == label)
    assert abs(weigh(1) - 1) < 1e-9 and abs(weigh(0) - 360) < 1e-6
    out = url_filter.judged(df, train_rows=20).collect()
    assert len(out) == len(rows) and all(r.score is not None for r in out)


def test_pages_plan_has_no_python(spark):
    df = url_filter.op3_url_filter(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and "html" not in plan
