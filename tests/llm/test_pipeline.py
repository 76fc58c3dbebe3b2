import corpus_pipeline as pipeline
import test_decontaminate
import test_line_dedup
import test_ngram_join
import test_packing

from shelfline.llm import line_dedup
from shelfline.llm.common import stored, table

FOLDER = "/root/testdata/sf0.001"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_stages_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    given = {}
    for name, stage in pipeline.STAGES:
        given[name] = docs
        docs = stored(stage(spark, docs, FOLDER), name)
        if name != "packing":
            assert docs.columns == columns

    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    kept = {r[0] for r in rows(given["line_dedup"], "doc_id")}
    known = {r[0] for r in rows(given["quality"], "doc_id")} & labels.keys()
    assert sum((k in kept) == (labels[k] == 1) for k in known) >= 0.95 * len(known)

    before = rows(given["line_dedup"], "doc_id", "text", "source")
    want = [(k, text, len(text)) for k, text, _, gone in test_line_dedup.brute(before, line_dedup.MIN_SITES)
            if not gone or text.strip(" ")]
    assert sorted(rows(given["near_duplicates"], "doc_id", "text", "n_chars")) == sorted(want)

    before = rows(given["near_duplicates"], "doc_id", "text")
    first = {k for k, _, c in test_ngram_join.brute(before) if k == c}
    assert sorted(rows(given["decontamination"], "doc_id", "text")) == sorted(r for r in before if r[0] in first)

    before = rows(given["decontamination"], "doc_id", "text")
    items = rows(table(spark, FOLDER, "benchmark"), "item_id", "text")
    clean = {r[0] for r in test_decontaminate.brute(before, items) if not r[-1]}
    assert sorted(rows(given["packing"], "doc_id", "text")) == sorted(r for r in before if r[0] in clean)

    test_packing.check(rows(given["packing"], "doc_id", "text"), rows(
        docs, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(1, long, "en", "a", 1, "x"), (1, long, "en", "a", 1, "x"), (2, long, None, None, None, None),
         (None, long, "en", "b", 2, "y"), (3, None, "en", "b", 0, "y"), (4, "", "en", "b", 0, "y")],
        "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "other words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for given in (docs, docs.limit(0)):
        out = given
        for name, stage in pipeline.STAGES:
            out = stored(stage(spark, out, folder), name)
            if name == "decontamination":
                ids = sorted((r[0] for r in rows(out, "doc_id")), key=str)
        if given is docs:
            assert ids == [1, 3, 4, None] and out.count() == 4
        else:
            assert out.count() == 0
