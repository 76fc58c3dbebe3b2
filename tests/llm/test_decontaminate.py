import hashlib
import re

from shelfline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = {}
    for k, text in items:
        w = split(text)
        if k is not None and w:
            n = min(10, len(w))
            for s in range(len(w) - n + 1):
                wins.setdefault(tuple(w[s:s + n]), set()).add(str(k))
    sizes = {len(w) for w in wins}
    out = []
    for k, text in docs:
        w, hit, ids = split(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[s:s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    ids |= found
        out.append((k, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, window int, found string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    out = decontaminate.with_matches(d, b).select(
        "row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_small_cases(spark):
    item = " ".join(f"term{i}" for i in range(25))
    items = [(1, item), (2, "Short item é"), (3, None), (4, "..."), (None, "no id here"), (2, "Short item é"),
             (10, " ".join(f"term{i}" for i in range(5, 17))), (11, "solo"), (12, "the the the the the the the the the the")]
    docs = [(1, f"x {item.upper()} y"), (2, "a " + " ".join(f"term{i}" for i in range(9))),
            (3, "pre " + ", ".join(f"term{i}" for i in range(3, 13))), (4, "a SHORT-item é b"), (5, "a short item É b"),
            (6, None), (7, ""), (8, "!?"), (None, f"{item}"), (9, f"{item} {item}"), (9, f"{item} {item}"),
            (10, "solo"), (11, "the " * 30), (12, "the " * 9), (13, " ".join(f"t{i}" for i in range(3000)) + " " + item),
            (14, " ".join(f"term{i}" for i in range(25) if i != 12))]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_near_windows(spark):
    item = "aa bb cc dd ee ff gg hh ii jj"
    d = spark.createDataFrame([(1, item), (2, "aa x bb cc dd ee ff gg hh ii jj"), (3, "aa bb " + "x " * 9)],
                              "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_near) for r in decontaminate.with_matches(d, b).select(
        "row.doc_id", "contaminated", "n_near").collect()}
    assert got[1] == (True, 1) and not got[2][0] and got[2][1] == 1


def test_near_does_not_depend_on_how_frequent_the_second_term_is(spark):
    """Eleven or forty documents with "the": the lists are intersected, or the texts are looked up."""
    b = spark.createDataFrame([(1, "zebra the")], "item_id long, text string")
    for others in (1, 40):
        rows = [(1, "zebra x the"), (2, "The x zebra"), (3, "zebra the"), (4, "zebra x x x the"), (5, "zebra"),
                (None, "the zebra")] + [(100 + k, "the " * 9) for k in range(others)]
        out = decontaminate.with_matches(spark.createDataFrame(rows, "doc_id long, text string"), b)
        got = {r.doc_id: r.n_near for r in out.select("row.doc_id", "n_near").collect()}
        assert [got[k] for k in (1, 2, 3, 4, 5, None)] == [1, 0, 1, 0, 0, 1] and got[100] == 0


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert run(spark, docs, items) == want and any(r[5] for r in want)
