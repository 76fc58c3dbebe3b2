import os

from shelfline.llm import common
from shelfline.llm.ngram_join import ngram_components


def folders(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_only_kept_tables_stay(spark):
    before = folders(spark)
    with common.Scratch() as outer:
        with common.Scratch() as inner:
            one, two, three = (common.stored(spark.range(k), f"t{k}") for k in (1, 2, 3))
            inner.drop(two)
            inner.keep(one)
        assert {f.split("-")[0] for f in folders(spark) - before} == {"t1"} and one.count() == 1
        assert [t[0] for t in outer.tables] == [one]
    assert folders(spark) == before
    assert spark.conf.get(common.CLEANUP) == "false"


def test_a_failure_leaves_nothing(spark):
    before = folders(spark)
    try:
        with common.Scratch():
            common.stored(spark.range(3), "lost")
            raise ValueError
    except ValueError:
        pass
    assert folders(spark) == before


def test_the_join_keeps_what_its_result_reads(spark):
    before = folders(spark)
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(k, " ".join(base[:30] + [f"x{k}"] + base[31:])) for k in range(4)],
                                 "doc_id long, text string")
    out = ngram_components(docs)
    assert {f.split("-")[0] for f in folders(spark) - before} == {"rows", "of"}
    assert [tuple(r) for r in out.select("component_id").distinct().collect()] == [(0,)]
