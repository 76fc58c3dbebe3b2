import hashlib

from shelfline.llm import line_dedup


def brute(rows, min_sites):
    """Exact distinct sites per line; ``rows`` are (doc_id, text, source)."""
    order = lambda k: (k is not None, k)
    sites, first = {}, {}
    for k, text, source in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.strip(" ")
            if line:
                sites.setdefault(line, set()).add(source or "")
                here = (order(k), pos)
                first[line] = min(first.get(line, here), here)
    out = []
    for k, text, _ in rows:
        if text is None:
            out.append((k, None, 0, 0))
            continue
        lines = text.split("\n")
        gone = {i for i, x in enumerate(lines) if len(sites.get(x.strip(" "), ())) >= min_sites
                and first[x.strip(" ")] != (order(k), i)}
        out.append((k, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


def run(spark, rows, min_sites):
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, source string, n_removed int, gone int")
    kept = line_dedup.remove_boilerplate(df, min_sites)
    assert kept.columns == ["doc_id", "text", "source", "gone", "n_lines", "n_removed"]
    return sorted((tuple(r) for r in kept.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str)


def test_small_cases(spark):
    rows = [(i, f"own {i}\n Licence line \n\n{'twice' if i < 2 else 'x'}\nLicence line\nend {i}", f"s{i % 4}") for i in range(8)]
    rows += [(20, None, "s9"), (21, "", "s9"), (None, "Licence line\nnull id", None), (22, "Licence line", "s1"),
             (22, "Licence line", "s1"), (23, "\n".join(["Licence line"] * 500 + ["kept"]), "s2"), (24, "\n\n", None)]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert run(spark, rows, 6) == brute(rows, 6)
    assert run(spark, [], 3) == []


def test_near_threshold_counts_are_exact(spark):
    """Spreads around 400 sites, where the sketch errs by several sites."""
    rows = [(1000 * n + s, f"line {n}", f"site {s}") for n in (395, 399, 400, 401, 405) for s in range(n)]
    assert run(spark, rows, 400) == brute(rows, 400)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    assert run(spark, rows, 3) == brute(rows, 3)
    digest = {r[0]: r[1:] for r in line_dedup.op4_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    for k, text, lines, gone in brute(rows, line_dedup.MIN_SITES):
        assert digest[k] == (lines, gone, hashlib.sha256((text or "").encode()).hexdigest())
