"""Secrets in texts: one automaton for all rules, spans in code points, redaction."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.automaton import Rule, Scanner

_KEY = r"""(password|passwd|secret|token|api_?key)"""
_VALUE = r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""

# A private key from its header to its END line: what lies between has no five dashes in a row. Without an
# END line it goes to the end of the body: fields of the header, then base64, blanks, line breaks and written ones (\n).
_LABEL = r"([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----"
_UNDASHED = r"(-?-?-?-?[^-])*"
_FIELD = r"(Proc-Type|DEK-Info|Version|Comment|MessageID|Hash|Charset):(-?-?-?-?[^\r\n-])*[\r\n]"
_FLAT_FIELD = r"(Proc-Type:\x20*[0-9]+,[A-Z]+|DEK-Info:\x20*[A-Z0-9]+(-[A-Z0-9]+)*(,[0-9A-Fa-f]+)?)[\x09-\x0D\x20\\]"
_BODY = rf"([\x09-\x0D\x20\\nr]*({_FIELD}|{_FLAT_FIELD}))*[A-Za-z0-9+/=\x09-\x0D\x20\\]*"
_HEADER = f"-----BEGIN {_LABEL}"

# The three base rules, then token shapes that their issuers publish. Lengths are checked
# after matching: counting them in the automaton would multiply its states.
BASE_RULES = [
    Rule("assign", _KEY + _VALUE, either_case=_KEY),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    Rule("hex", "[0-9a-f]{8}[0-9a-f]*", least=32),
]
MORE_RULES = [
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", least=40),
    Rule("private_key", f"{_HEADER}({_UNDASHED}-----END {_LABEL}|{_BODY})", opening=_HEADER),
]
RULES = BASE_RULES + MORE_RULES

# A found assignment counts if its value has so many characters.
LEAST_VALUE = 8
_ASSIGNED = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""")
PIECE_ROWS = 256


@dataclass(frozen=True)
class Span:
    rule: int
    start: int
    end: int

    def __str__(self) -> str:
        return f"{RULES[self.rule].kind}:{self.start}:{self.end}"


def find_secrets(scanner: Scanner, text: str) -> list[Span]:
    """Spans in code points, by start, then in the order of the rules."""
    raw = text.encode()
    found = []
    for rule, start, end in scanner.scan(raw):
        if rule == 0 and end - _ASSIGNED.match(raw, start, end).end() < LEAST_VALUE:
            continue
        found.append((start, rule, end))
    found.sort()
    if len(raw) == len(text):
        return [Span(rule, start, end) for start, rule, end in found]
    spans, at, chars = [], 0, 0
    for start, rule, end in found:
        chars += len(raw[at:start].decode())
        at = start
        spans.append(Span(rule, chars, chars + len(raw[start:end].decode())))
    return spans


def redacted(text: str, spans: list[Span], marker: str) -> str:
    """``text`` with every stretch covered by spans replaced by one ``marker``."""
    out, at = [], 0
    end = -1
    for span in sorted(spans, key=lambda s: (s.start, s.end)):
        if span.start >= end:
            if end >= 0:
                out.append(marker)
            out.append(text[max(at, 0) : span.start])
            end = span.end
        end = at = max(end, span.end)
    return "".join(out) + (marker if end >= 0 else "") + text[max(at, 0) :]


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    """Compiled once per worker from the rules above."""
    if not _scanner:
        _scanner.append(Scanner(RULES))
    return _scanner[0]


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans for every row.

    A null or empty text has no spans; its digest is that of the empty text. Rows stand for
    themselves, repeated ones too; other columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find_secrets(scanner(), x.as_py() or "") for x in batch.column("text")]
        count = lambda rule: pa.array([sum(s.rule == rule for s in spans) for spans in found], pa.int64())
        base = [",".join(str(s) for s in spans if s.rule < len(BASE_RULES)) for spans in found]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_assign": count(0),
                "n_access": count(1),
                "n_hex": count(2),
                "base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]),
                "spans": pa.array([",".join(map(str, spans)) for spans in found]),
                "n_spans": pa.array([len(spans) for spans in found], pa.int64()),
            }
        )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
    return _mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), work, schema)


def redact_secrets(docs: DataFrame, text: str = "text", marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by ``marker``; all rows and columns stay, nulls too."""
    names = docs.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = [None if (own := x.as_py()) is None else redacted(own, find_secrets(scanner(), own), marker) for x in batch.column(text)]
        columns = [pa.array(clean, pa.string()) if c == text else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return _mapped(docs, work, docs.schema)


def _mapped(df: DataFrame, work, schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                yield work(batch.slice(start, PIECE_ROWS))

    return df.mapInArrow(run, schema)
