"""URL filter: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

The URLs that rules decide are the labelled ones; trees are trained on a bounded sample of different ones of both
labels (``TRAIN_ROWS`` of smallest hash), weighted by their rows. Suffix statistics are counted over all URLs. Everything is DataFrame functions and Spark's own boosted
trees; nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, table

# Rule (host, then path) and verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
TRAIN_ROWS = 20_000
ROUNDS, DEPTH = 20, 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ["length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "parameters",
            "fragment", "hyphens", "longest_label", "secure", "suffix_count", "suffix_rate", "site_count", "site_rate"]


def host(url: Column | str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule(rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits ``host`` and its parents' subdomains and begins ``path``; else null."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, slash, rest = text.partition("/")
        fits = ((F.col("host") == site) | F.endswith(F.col("host"), F.lit("." + site))) \
            & F.startswith(F.col("path"), F.lit(slash + rest))
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def entropy() -> Column:
    """Bits per character of ``_text``, from the runs of its sorted characters; 0 for an empty one."""
    # State: character, its run so far, sum of n * log2(n) over finished runs.
    state = "named_struct('c', '', 'n', 0D, 's', 0D)"
    gain = "if(a.n > 0, a.n * log2(a.n), 0D)"
    runs = F.expr(f"""aggregate(sort_array(split(_text, '')), {state},
        (a, x) -> if(x = a.c, named_struct('c', a.c, 'n', a.n + 1, 's', a.s),
                     named_struct('c', x, 'n', 1D, 's', a.s + {gain})),
        a -> a.s + {gain})""")
    return F.when(F.length("_text") > 0, F.log2(F.length("_text")) - runs / F.length("_text")).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the features of the URL itself, its suffix and its site (last two labels)."""
    text = F.coalesce("url", F.lit(""))
    out = urls.withColumn("_text", text)
    return out.select(
        *urls.columns, F.length("_text").alias("length"), F.length("host").alias("host_length"),
        F.length("path").alias("path_length"), F.regexp_count("host", F.lit(r"\.")).alias("host_depth"),
        F.regexp_count("path", F.lit("/")).alias("path_depth"),
        (F.regexp_count("_text", F.lit("[0-9]")) / F.greatest(F.length("_text"), F.lit(1))).alias("digit_ratio"),
        entropy().alias("entropy"), F.regexp_count("_text", F.lit("[?&]")).alias("parameters"),
        F.contains("_text", F.lit("#")).cast("int").alias("fragment"),
        F.regexp_count("host", F.lit("-")).alias("hyphens"),
        F.array_max(F.transform(F.split("host", r"\."), F.length)).alias("longest_label"),
        F.startswith(F.lower("_text"), F.lit("https:")).cast("int").alias("secure"),
        F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("site"))


def _statistics(urls: DataFrame, key: str) -> DataFrame:
    """Count and smoothed share of blocked labels of each suffix or site, over all URLs."""
    return stored(urls.groupBy(key).agg(
        F.log1p(F.count("*")).alias(f"{key}_count"),
        ((F.count_if(F.col("label") == 1) + 1) / (F.count("label") + 2)).alias(f"{key}_rate")), key)


def features(urls: DataFrame) -> DataFrame:
    out = lexical(urls)
    for key in ("suffix", "site"):
        # A suffix may be a third of all URLs: counts combine in each task before they move.
        out = out.join(_statistics(out.select(key, "label"), key), key)
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(out)


def sampled(data: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame | None:
    """Different labelled URLs of smallest hash, half of ``rows`` for each label; a label with fewer leaves its places
    to the other. A URL weighs its rows, times what makes each label weigh all its rows. None without both labels."""
    urls = stored(data.where("label IS NOT NULL").groupBy("label", "url").agg(F.count("*").alias("times"))
                  .withColumn("h", F.xxhash64("url")), "labelled-urls")
    all_of = {r.label: r for r in urls.groupBy("label").agg(F.count("*").alias("urls"), F.sum("times").alias("rows"))
              .collect()}
    if len(all_of) < 2:
        return None
    chosen = None
    for label, row in all_of.items():
        places = max(1, rows // 2, rows - all_of[1 - label].urls)
        some = stored(urls.where(F.col("label") == label).orderBy("h", "url").limit(places), "chosen")
        some = some.withColumn("weight", F.col("times") * (row.rows / some.agg(F.sum("times")).first()[0]))
        chosen = some if chosen is None else chosen.union(some)
    return stored(data.where("label IS NOT NULL").select("url", "features").join(chosen, "url")
                  .select("url", "features", F.col("label").cast("double").alias("label"), "weight")
                  .dropDuplicates(["url"]), "labelled")


def trained(data: DataFrame, rows: int = TRAIN_ROWS):
    """Boosted trees on ``sampled`` URLs; None without both labels."""
    sample = sampled(data, rows)
    if sample is None:
        return None
    return GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=1, labelCol="label", featuresCol="features",
                         weightCol="weight", cacheNodeIds=False).fit(sample)


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``pages`` (page_id, url) -> page_id, host, path, rule, verdict, score; one row per input row.

    The score is the trees' probability of a block. A null url, or one without ://, has an empty host and path and is
    judged by the trees. Without labelled URLs of both kinds the verdict of the only kind holds, else allow, and the
    score is null. Null page_ids and repeated rows are kept; other columns are ignored; an empty table gives an empty
    result.
    """
    verdict = F.lit(None).cast("string")
    for text, kind in rules:
        verdict = F.when(F.col("rule") == text, F.lit(kind)).otherwise(verdict)
    urls = pages.select("page_id", "url").withColumn("host", host("url")).withColumn("path", path("url")) \
        .withColumn("rule", rule(rules)).withColumn("ruled", verdict) \
        .withColumn("label", (F.col("ruled") == "block").cast("int"))
    data = stored(features(urls), "features")
    model = trained(data, train_rows)
    if model is None:
        only = data.where("ruled IS NOT NULL").select("ruled").first()
        guess, score = F.lit(only[0] if only else "allow"), F.lit(None).cast("double")
    else:
        data = model.transform(data)
        score = vector_to_array("probability")[1]
        guess = F.when(score >= 0.5, "block").otherwise("allow")
    return data.select("page_id", "host", "path", "rule", F.coalesce("ruled", guess).alias("verdict"),
                       score.alias("score"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
