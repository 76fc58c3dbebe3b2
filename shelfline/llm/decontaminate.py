"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

The benchmark is cut into windows of consecutive words. Counting its vocabulary in the training documents ranks each
window's terms from rare to frequent; the index stores the positions of those words that are among the two rarest
terms of some window. A posting list is adjusted by its term's offset, so that lists of one window meet in the
window's start; where the second list is much longer than the first, the text of the first list's documents stands in
for it, with the same results. What the lists have in common is compared with the whole window (exact phrase). Windows
whose two rarest terms lie within ``slop`` words of their places are counted as near.

The benchmark's tables are stored first: Spark broadcasts them when their measured size is small enough and shuffles
single words, without texts, otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, stored, table

WINDOW = 10
SLOP = 2
# A second list of up to this many times the first one's length is intersected; a longer one is looked up in the texts.
LONGER = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What separates words: ASCII except digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """The words of a text as they are written; none for null."""
    return F.coalesce(F.filter(F.split(text, BREAKS, -1), lambda w: w != ""), F.array().cast("array<string>"))


def lowered(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, window, size, terms: every window of ``width`` words of each item, a shorter item being one window."""
    w = benchmark.where("item_id IS NOT NULL").select("item_id", F.transform(words("text"), lowered).alias("w"))
    w = w.where(F.size("w") > 0).select("item_id", "w", F.explode(
        F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).alias("at"))
    w = w.select("item_id", F.slice("w", F.col("at"), F.lit(width)).alias("terms")).distinct()
    return w.select("item_id", "terms", F.size("terms").alias("size"),
                    F.xxhash64("item_id", "terms").alias("window"))


def with_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """``docs`` as a column ``row`` with n_words, n_hit, n_items, items_sha256, contaminated and n_near.

    One row per input row. A null or empty text has no words; items without a word or with a null id are left out.
    Repeated rows and rows with a null doc_id are treated like any other; repeated items count once. Columns other
    than doc_id and text only pass through. Empty tables give no hits or no rows.
    """
    with Scratch() as scratch:
        found = _found(docs, benchmark, width, slop)
        scratch.keep(found)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("found_id"))
                       & (F.xxhash64("row.text") == F.col("found_hash")), "left")
    joined = joined.withColumn("w", words("row.text"))
    # Letters are lowered word by word only where there is something to compare.
    joined = joined.withColumn("low", F.when(F.col("found").isNotNull(), F.transform("w", lowered)))

    def exact(c: Column) -> Column:
        at = F.greatest(c["start"], F.lit(0))
        return (c["start"] >= 0) & (F.slice("low", at + 1, F.size(c["terms"])) == c["terms"])

    def second_near(c: Column) -> Column:
        at = c["start"] + c["second"]["offset"]
        first = F.greatest(at - slop, F.lit(0))
        around = F.slice("w", first + 1, F.greatest(at + slop + 1 - first, F.lit(0)))
        return F.exists(around, lambda x: F.lower(x) == c["second"]["term"])

    none = F.array().cast(found.schema["found"].dataType)
    joined = joined.withColumn("hits", F.coalesce(F.filter("found", exact), none))
    looked_up = F.coalesce(F.filter("found", lambda c: c["second"].isNotNull() & second_near(c)), none)
    near = F.size(F.array_distinct(F.transform(looked_up, lambda c: F.struct(c["item_id"], c["terms"]))))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda c: c["item_id"].cast("string"))))
    return joined.select(
        "row", F.size("w").cast("long").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(
            c["start"], c["start"] + F.size(c["terms"]) - 1))))).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), (F.coalesce("n_near", F.lit(0)) + near).cast("long").alias("n_near"))


def _found(docs: DataFrame, benchmark: DataFrame, width: int, slop: int) -> DataFrame:
    """Per text with candidates (found_id, found_hash): ``found``, places where a window may start, with the second
    rarest term where that is still to be looked up, and ``n_near`` of the windows that need no look."""
    win = stored(windows(benchmark, width), "windows")
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]

    # Full lower-casing is quicker than A-Z only and merges no two words that should stay together; the phrase
    # comparison below is exact.
    spot = win.select("window", "size", F.posexplode("terms").alias("offset", "term")) \
        .withColumn("term", F.lower("term"))
    vocabulary = stored(spot.select("term").distinct(), "vocabulary")
    said = docs.select(F.explode(words("text")).alias("w")).select(F.lower("w").alias("term"))
    counts = stored(said.join(vocabulary, "term").groupBy("term").count(), "counts")

    ranked = spot.join(counts, "term", "left").groupBy("window", "size").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "offset", "term")))
        .alias("by_rarity")).where("by_rarity[0].n > 0")
    ranked = ranked.withColumn("use", F.when(
        (F.size("by_rarity") > 1) & (F.expr("try_element_at(by_rarity, 2).n") <= LONGER * F.expr("by_rarity[0].n")), 2)
        .otherwise(1))
    ranked = stored(ranked, "ranked")
    lists = stored(ranked.select("window", "use", F.posexplode(F.slice("by_rarity", F.lit(1), F.col("use")))
                                 .alias("rank", "t")).select("window", "use", "rank", "t.offset", "t.term"), "lists")

    terms = stored(lists.select("term").distinct(), "terms")
    index = stored(docs.select(*key, F.posexplode(words("text")).alias("pos", "w"))
                   .select("doc_id", "text_hash", "pos", F.lower("w").alias("term")).join(terms, "term"), "index")
    adjusted = index.join(lists, "term").select(
        "window", "use", "doc_id", "text_hash", (F.col("pos") - F.col("offset")).alias("start"),
        F.expr("shiftleft(1, `rank`)").alias("list"))
    starts = stored(adjusted.groupBy("window", "use", "doc_id", "text_hash", "start")
                    .agg(F.bit_or("list").alias("lists")), "starts")

    # A window with one list may start before the text does and still be near.
    common = starts.where((F.col("lists") == F.expr("shiftleft(1, `use`) - 1")) & F.expr("start >= 0 OR `use` = 1"))
    second = ranked.select("window", F.when(F.col("use") == 1, F.expr("try_element_at(by_rarity, 2)")).alias("second"))
    found = common.join(win.join(second, "window"), "window").groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "item_id", "terms", "second")).alias("found"))

    # Two lists are near where their starts differ by at most ``slop``: each start is put into the blocks it reaches.
    two = starts.where("use = 2")
    first = two.where("lists & 1 = 1").select("window", "doc_id", "text_hash", F.col("start").alias("a"),
                                             F.floor(F.col("start") / (slop + 1)).alias("block"))
    second = two.where("lists & 2 = 2").select(
        F.col("window").alias("w2"), F.col("doc_id").alias("d2"), F.col("text_hash").alias("h2"),
        F.col("start").alias("b"), F.explode(F.array_distinct(F.array(*[
            F.floor((F.col("start") + d) / (slop + 1)) for d in (-slop, 0, slop)]))).alias("b2"))
    near = first.join(second, (F.col("window") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("d2"))
                      & (F.col("text_hash") == F.col("h2")) & (F.col("block") == F.col("b2"))
                      & (F.abs(F.col("a") - F.col("b")) <= slop)).select("window", "doc_id", "text_hash").distinct() \
        .groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_near"))
    return stored(found.join(near.withColumnsRenamed({"doc_id": "d2", "text_hash": "h2"}),
                              F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_hash") == F.col("h2")), "full")
                   .select(F.coalesce("doc_id", "d2").alias("found_id"), F.coalesce("text_hash", "h2")
                           .alias("found_hash"), "found", "n_near"), "found")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    out = with_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP5_SQL = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_PATTERN}') AS w
               FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_PATTERN}') AS w
          FROM benchmark WHERE item_id IS NOT NULL),
    win AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, list_slice(w, s, s + least({WINDOW}, len(w)) - 1) AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
    place AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS g
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
                    FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
    hits AS (SELECT doc_id, s, n, item_id FROM place JOIN win USING (g, n)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id),
    said AS (SELECT doc_id, lower(unnest(w)) AS term, unnest(range(len(w))) AS pos FROM d),
    spot AS (SELECT item_id, g, lower(unnest(g)) AS term, unnest(range(len(g))) AS place FROM win),
    ranked AS (SELECT item_id, g, term, place, coalesce(c, 0) AS c,
                   row_number() OVER (PARTITION BY item_id, g ORDER BY coalesce(c, 0), place, term) AS r
               FROM spot LEFT JOIN (SELECT term, count(*) AS c FROM said GROUP BY 1) USING (term)),
    close AS (SELECT DISTINCT x.doc_id, a.item_id, a.g FROM ranked a JOIN ranked b USING (item_id, g)
              JOIN said x ON x.term = a.term JOIN said y ON y.doc_id = x.doc_id AND y.term = b.term
                AND abs((x.pos - a.place) - (y.pos - b.place)) <= {SLOP}
              WHERE a.r = 1 AND b.r = 2 AND a.c > 0),
    nears AS (SELECT doc_id, count(*) AS n_near FROM close GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)"""
