"""Secret scan: one automaton for all rules reads every text's bytes once; texts and rules it reports are resolved.

The automaton holds, for each rule, a text that every match contains. No rule matches across a line break, so the
exact pattern is then run only on the lines in which the automaton saw its rule end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .automaton import compiled
from .common import steps, table

# Kind, what the automaton looks for, exact pattern, its group whose length counts, least length.
# Long counts stay out of the automaton (but for hex, which has no other mark): states would multiply.
RULES = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=\-]",
     r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16}", r"[0-9a-f]+", 0, 16),
    ("hosting", r"gh[pousr]_[A-Za-z0-9]", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9\-]", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("cloud", r"AIza[A-Za-z0-9_\-]", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("payment", r"[rs]k_live_[A-Za-z0-9]", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("web_token", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.",
     r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]
BASE = ("assign", "access", "hex")
SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class Scanner:
    def __init__(self) -> None:
        self.automaton = compiled([seen for _, seen, *_ in RULES])
        self.exact = [(kind, re.compile(pattern, re.ASCII), group, least) for kind, _, pattern, group, least in RULES]

    def spans(self, text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, from (rule, position in the text) marks of the automaton."""
        out = []
        done: set[tuple[int, int]] = set()
        for rule, at in lines:
            begin = text.rfind("\n", 0, at) + 1
            if (rule, begin) in done:
                continue
            done.add((rule, begin))
            end = text.find("\n", at)
            _, pattern, group, least = self.exact[rule]
            for m in pattern.finditer(text, begin, len(text) if end < 0 else end):
                if m.end(group) - m.start(group) >= least:
                    out.append((m.start(), rule, m.end()))
        return sorted(out)

    def texts(self, text: pa.Array) -> list[list[tuple[int, int, int]]]:
        """The spans of each text; the texts are read as one run of bytes with line breaks between them."""
        if not pa.types.is_large_string(text.type):
            text = text.cast(pa.large_string())
        text = pc.binary_join_element_wise(pc.fill_null(text, ""), pa.scalar("\n", pa.large_string()),
                                           pa.scalar("", pa.large_string()))
        out: list[list] = [[] for _ in range(len(text))]
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] else \
            np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        where, masks = self.automaton.scan(data)
        order = np.argsort(where, kind="stable")
        where, masks = where[order], masks[order]
        rows = np.searchsorted(offsets, where, side="right") - 1
        for row in np.unique(rows).tolist():
            mine = rows == row
            value = text[row].as_py()[:-1]
            start = int(offsets[row])
            raw = data[start:start + int(where[mine].max()) - start + 1]
            # Code points before a byte: bytes that do not continue one.
            points = np.cumsum((raw & 0xC0) != 0x80) - 1
            marks = [(rule, int(points[at - start])) for at, mask in zip(where[mine], masks[mine])
                     for rule in range(len(RULES)) if mask >> rule & 1]
            out[row] = self.spans(value, marks)
        return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[rule][0]}:{start}:{end}" for start, rule, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in steps(batches):
        found = scanner.texts(batch.column("text"))
        base = [[s for s in spans if RULES[s[1]][0] in BASE] for spans in found]
        counts = [pa.array([sum(RULES[s[1]][0] == kind for s in spans) for spans in base], pa.int64()) for kind in BASE]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *counts,
             pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base], pa.string()),
             pa.array([_joined(s) for s in found], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per input row: counts of the base kinds, their digest, and all spans as
    kind:start:end in code points, end exclusive, by start and then kind as listed.

    A null or empty text has no spans. Null doc_ids and repeated rows are kept; other columns are ignored; an empty
    table gives an empty result. Matches of one kind do not overlap; those of different kinds may.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SPANS)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
