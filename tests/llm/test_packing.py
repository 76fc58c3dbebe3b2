import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfline.llm import packing

SCHEMA = "doc_id long, text string, start int, sequence_id string"


def run(spark, rows, **kw):
    df = packing.pack(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA), **kw)
    return [tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                        "offset").collect()]


def check(rows, out, window=2048):
    """Every id in exactly one piece; windows without gaps or overfill."""
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in rows)
    by_id = {}
    for (k, t) in rows:
        by_id.setdefault(k, []).append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    assert sum(r[2] for r in out) == sum(map(len, want))
    for k, start, length, crc, total, *_ in out:
        assert any(len(i) == total and zlib.crc32(i[start:start + length].tobytes()) == crc for i in by_id[k])
    for k, ids in by_id.items():
        mine = sorted((r[1], r[2]) for r in out if r[0] == k)
        if len(ids) == 1:
            assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
    windows = {}
    for r in out:
        windows.setdefault(r[5], []).append((r[6], r[2]))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
    return len(windows)


def test_small_cases(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "Hello wörld"), (None, "no id"), (4, "Hello wörld"),
            (6, "word " * 5000), (7, "a" * 3000), (8, "x " * 2047), (9, "x " * 2046)]
    check(rows, run(spark, rows))
    assert run(spark, []) == []


def test_added_tokens_in_capitals(spark):
    rows = [(1, "<|ENDOFTEXT|> a"), (2, "b <|StartOfText|>"), (3, "X<|EndOfText|>Y."), (4, "<|endoftext|> <|startoftext|>"),
            (5, "A<|ENDOFTEXT|>."), (6, "<|ENDOFTEXT|")]
    check(rows, run(spark, rows))


def test_letters_that_normalisation_splits(spark):
    rows = [(1, "\u0130, I\u0130. \u0130"), (2, "\u092a\u095d. \u092a\u095dx,"), (3, "\u05d0\ufb31! e\u0301, \u00e9,")]
    check(rows, run(spark, rows))


def test_all_letters_before_marks():
    """Each letter alone and after another one, with marks behind it, against the tokenizer on the whole word."""
    letters = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo")]
    tokenizer, words = Tokenizer.from_file(packing.tokenizer_path()), packing.Words(packing.tokenizer_path())
    for at in range(0, len(letters), 20_000):
        texts = [f"{c},;" for c in letters[at:at + 20_000]] + [f"a{c}." for c in letters[at:at + 20_000:7]]
        want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert all(list(got) == w.ids for got, w in zip(words.texts(pa.array(texts)), want))


def test_latin_words_are_joined_and_told_apart(monkeypatch):
    """Every Latin-1 character inside words, in texts of several batches, with an encoder that forgets between them."""
    tokenizer, words = Tokenizer.from_file(packing.tokenizer_path()), packing.Words(packing.tokenizer_path())
    monkeypatch.setattr(packing, "KNOWN", 700)
    monkeypatch.setattr(packing, "JOINED", 7)
    chars = [chr(c) for c in range(0x21, 0x100)]
    texts = [f"{a}{b}{a}t {b}a, <|{a} x{a}" for a in chars for b in (chars[::29])] + ["", None, "stra\u00dfe \u00c9T\u00c9!"]
    for at in (0, 0, 600, 1100):
        some = texts[at:at + 500] + texts[-3:]
        want = tokenizer.encode_batch_fast([t or "" for t in some], add_special_tokens=False)
        got = list(words.texts(pa.array(some, pa.large_string())))
        assert len(got) == len(some) and all(list(g) == w.ids for g, w in zip(got, want))


def test_documents_fill(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    out = run(spark, rows, group_windows=64)
    n = check(rows, out)
    assert sum(r[2] for r in out) / (n * 2048) > 0.98
    assert sorted(out) == sorted(run(spark, rows[::-1], group_windows=64))


@pytest.mark.parametrize("k", [1, 2, 5])
def test_differencing_is_a_partition(k):
    lengths = np.random.default_rng(k).integers(1, 100, 40)
    window, sums = packing.differencing(lengths, k)
    assert sorted(np.bincount(window, lengths, minlength=k)) == sorted(sums)
    assert sums[0] - sums[-1] <= lengths.max()


def test_windows_are_added_until_all_fits():
    lengths = np.array([600, 600, 600, 600, 600, 600])
    window = packing.packed_group(lengths, 1000)
    assert np.bincount(window, lengths).max() <= 1000 and window.max() == 5
