"""Packing of token pieces into windows by multiway differencing (Karmarkar-Karp).

Every document is tokenised and closed with an end token. Pieces that fill a window are cut off first and form windows
of their own; the rest of each document, shorter than a window, is cut at thirds of a window (whole rests of up to a
window leave some 5 % of padding, thirds well under 1 %). These pieces are dealt by hash into groups of about
``GROUP_WINDOWS`` windows, and each group is packed by differencing: partial partitions are merged largest difference
first, the fullest windows of one onto the emptiest of the other, so that differences cancel. Where the fullest window
exceeds the capacity, the group is packed again into more windows.

Only piece lengths are grouped, never texts; a very long document is spread over all groups.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import steps, stored, table, words

WINDOW = 2048
END_ID = 1
# Windows per group: the group's last, partly filled window costs at most this fraction's inverse.
GROUP_WINDOWS = 256

# Marks after which the vocabulary starts a new piece when they follow a letter.
MARKS = ".,!?;:*$%&#|"
# The one letter whose small form is a letter and a combining mark.
EXPANDING = "\u0130"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# Letters of one code point each, small, that normalisation leaves as they are.
PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
# Different parts that an encoder remembers, and parts joined into one text for the tokenizer.
KNOWN, JOINED = 400_000, 5_000


class Words:
    """Token ids by white-space separated word, each different word encoded once.

    The vocabulary drops white space and never joins what stands on its two sides, so a text's ids are those of its
    words in a row. It also starts a new piece where one of ``MARKS`` follows a letter, and lowers capitals; a word
    that ends so is encoded as the part up to its last letter, lowered if it is Latin-1, and the marks. That letter
    must still be one after normalisation, which may make it a letter and a combining mark; else the word stays whole.
    Added tokens such as <|endoftext|> are found in the text as it stands, so a part with "<|" keeps its capitals.

    Parts of ``PLAIN`` letters are one piece each, which ends at the first token with the vocabulary's end-of-word
    suffix. So many of them are encoded as one text, and their ids are told apart by these tokens.
    """

    def __init__(self, path: str) -> None:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([""], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.lengths = np.zeros(1, np.int64)

    def encode(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and their number in each text."""
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(values, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def encode_plain(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = np.append(np.arange(0, len(values), JOINED), len(values)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), values.cast(pa.string()))
        ids, _ = self.encode(pc.binary_join(lists, " ").to_pylist())
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != len(values):
            return self.encode(values.to_pylist())
        return ids, np.diff(ends, prepend=-1)

    def learn(self, values: pa.Array) -> None:
        plain = pc.match_substring_regex(values, PLAIN)
        for some, encode in ((values.filter(plain), self.encode_plain),
                             (values.filter(pc.invert(plain)), lambda v: self.encode(v.to_pylist()))):
            if len(some):
                ids, lengths = encode(some)
                self.known = pa.concat_arrays([self.known, some])
                self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])

    def looked_up(self, parts: pa.Array) -> np.ndarray:
        """The place of each part among the known ones, after the missing ones have been encoded."""
        if len(self.known) > KNOWN:
            self.forget()
        missing = parts.filter(pc.invert(pc.is_in(parts, self.known)))
        if len(missing):
            self.learn(pc.unique(missing))
        return pc.index_in(parts, self.known).to_numpy(zero_copy_only=False).astype(np.int64)

    def texts(self, text: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        flat, offsets = words(text)
        both = flat.dictionary_encode()
        vocabulary = both.dictionary
        split = pc.extract_regex(vocabulary, rf"(?s)^(?P<body>.*\p{{L}})(?P<marks>[{MARKS}]+)$")
        body = pc.struct_field(split, 0)
        steady = pc.and_not(pc.equal(body, pc.utf8_normalize(body, "NFC")), pc.ends_with(body, EXPANDING))
        cut = pc.fill_null(steady, False)
        body = pc.if_else(cut, body, vocabulary)
        marks = pc.if_else(cut, pc.struct_field(split, 1), "")
        lowered = pc.and_not(pc.match_substring_regex(body, "(?s)^[\\x00-\\x{ff}]*$"), pc.match_substring(body, "<|"))
        body = pc.if_else(lowered, pc.utf8_lower(body), body)
        place = self.looked_up(pa.concat_arrays([body, marks]))
        first = np.cumsum(self.lengths) - self.lengths
        of_word = place.reshape(2, -1).T[both.indices.to_numpy(zero_copy_only=False)].ravel()
        n = self.lengths[of_word]
        ends = np.concatenate([[0], np.cumsum(n)])
        everything = self.ids[np.arange(ends[-1]) + np.repeat(first[of_word] - ends[:-1], n)]
        for start, stop in zip(ends[2 * offsets[:-1]], ends[2 * offsets[1:]]):
            yield everything[start:stop]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Words:
    """One encoder per Python worker; tasks that follow in it find the parts of those before."""
    return Words(path)


def _cutter(path: str, window: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in steps(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), known.texts(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                whole = len(ids) // window * window
                starts = [*range(0, whole, window), *range(whole, len(ids), window // 3)]
                for start, stop in zip(starts, [*starts[1:], len(ids)]):
                    piece = ids[start:stop]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return cut


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``docs`` (doc_id, text) as pieces of at most ``window`` ids, with the CRC-32 of each piece's ids."""
    return docs.select("doc_id", "text").mapInArrow(_cutter(path or tokenizer_path(), window, end_id), PIECES)


def differencing(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition of ``lengths`` into ``k`` windows: the window of each piece, and the windows' sums.

    A partial partition holds ``k`` sums in descending order and, per sum, a chain of pieces. Single pieces are
    partial partitions with one sum above zero. The two with the largest differences between their fullest and
    emptiest window are merged in opposite order until one is left.
    """
    follow = np.full(len(lengths), -1, np.int64)
    heap: list[tuple[int, int, object]] = [(-int(n), i, None) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    count = len(lengths)

    def opened(i: int, node):
        if node is not None:
            return node
        sums, head, tail = np.zeros(k, np.int64), np.full(k, -1, np.int64), np.full(k, -1, np.int64)
        sums[0], head[0], tail[0] = lengths[i], i, i
        return sums, head, tail

    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        sums, head, tail = opened(i, a)
        other, other_head, other_tail = (x[::-1] for x in opened(j, b))
        join = (head >= 0) & (other_head >= 0)
        follow[tail[join]] = other_head[join]
        head = np.where(head >= 0, head, other_head)
        tail = np.where(other_head >= 0, other_tail, tail)
        sums = sums + other
        order = np.argsort(-sums, kind="stable")
        sums, head, tail = sums[order], head[order], tail[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), count, (sums, head, tail)))
        count += 1
    _, i, node = heap[0]
    sums, head, _ = opened(i, node)
    window = np.empty(len(lengths), np.int64)
    for w, piece in enumerate(head.tolist()):
        while piece >= 0:
            window[piece] = w
            piece = follow[piece]
    return window, sums


def packed_group(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; windows are added until the fullest fits."""
    k = max(1, -(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))
    while True:
        window, sums = differencing(lengths, k)
        if sums[0] <= capacity:
            return window
        k += max(1, k // 256)


def _packer(window: int, groups: int):
    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # The order must not depend on how the shuffle delivered the rows.
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True],
                              kind="stable", ignore_index=True)
        full = (pdf["length"] == window).to_numpy()
        local = np.empty(len(pdf), np.int64)
        local[full] = np.arange(full.sum())
        rest = pdf["length"].to_numpy()[~full]
        if len(rest):
            local[~full] = full.sum() + packed_group(rest, window)
        pdf["sequence_id"] = local * groups + key[0]
        order = np.lexsort((np.arange(len(pdf)), local))
        lengths = pdf["length"].to_numpy()[order]
        before = np.cumsum(lengths) - lengths
        at = local[order]
        first = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]], np.arange(len(at)), 0))
        offset = np.empty(len(pdf), np.int64)
        offset[order] = before - before[first]
        pdf["offset"] = offset
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]
    return pack


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID,
         group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per piece, with its sequence and its offset there.

    A null or empty text is the end token alone. Rows with a null doc_id and repeated rows are packed like any other;
    each input row's ids are packed once. Other columns are ignored; an empty table gives an empty result.
    """
    cut = stored(pieces(docs, path, window, end_id), "pieces")
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / (window * group_windows)))
    # Pieces that are equal in every column are one counted row until each copy is dealt to a group of its own.
    counted = cut.groupBy(*cut.columns).agg(F.count("*").alias("times")) \
        .withColumn("part", F.explode(F.expr("sequence(0, (times - 1) DIV 100000)"))) \
        .withColumn("copy", F.explode(F.expr("sequence(part * 100000, least(times, (part + 1) * 100000) - 1)")))
    dealt = counted.select(*cut.columns, F.pmod(
        F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(groups)).alias("group"))
    packer = _packer(window, groups)
    return dealt.groupBy("group").applyInPandas(
        lambda key, pdf: packer(key, pdf.astype({"doc_id": "Int64"})), PACKED)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
