"""Secrets in texts: all rules in one minimal automaton, one pass over the bytes.

A rule has a head, a regular expression that ends with the first bytes of what may run on,
and a class of bytes with which its span runs on. The combined automaton of all heads
reports every byte at which one ends. A span begins where the head's own automaton, read
backwards from there, begins it, and ends with the run of the rule's class; some rules ask
for further runs behind. Runs are read off the places of bytes outside the class, so a
byte is never looked at once for each hit, whatever the text.

Spans of a rule do not overlap, the leftmost come first. What is shorter than a base rule
asks for is no span, but what follows begins behind it (nothing is tried again in its
place). Further rules try again.

Rules assign, access and hex are the base ones. github, slack, jwt and pem add spans of
further well-known formats. Defined cases: null and empty texts have no spans; an empty
table gives an empty one; texts of any length are read whole, in bounded blocks; repeated
rows and doc_ids, and null doc_ids, give a result for each row; ties (spans of two rules at
one place) stand in the order of the rules; other columns, whatever they are called, are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton, compile_reversed, compile_rules, first_byte, scan
from .hashing import text_blocks

#: Bytes that are scanned together, at least one text.
BLOCK_BYTES = 4_000_000


@dataclass(frozen=True)
class Rule:
    """One kind of secret.

    head: what the automaton looks for. runs: the bytes with which the span goes on behind
    the head's last byte. least: bytes of it, counted from `skip` bytes behind its start, or
    from the head's last byte if skip is None. back: the span also reaches back through
    runs. more: (text, least) pairs that must follow, each a text and a run.
    """

    kind: str
    head: str
    runs: str = ""
    least: int = 0
    skip: int | None = 0
    back: bool = False
    more: tuple[tuple[bytes, int], ...] = ()
    base: bool = False


# The base rules' patterns and lengths, and public formats of keys.
_VALUE = "[A-Za-z0-9+/_.=-]"
_KEYWORDS = "password|passwd|secret|token|api_?key"
_WEB = "[A-Za-z0-9_-]"
RULES = (
    Rule("assign", f"(?i:{_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?{_VALUE}", _VALUE, 8, skip=None, base=True),
    Rule("access", "AKIA[A-Z0-9]", "[A-Z0-9]", 16, base=True),
    Rule("hex", "[0-9a-f]{32}", "[0-9a-f]", 32, back=True, base=True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{4}", "[A-Za-z0-9]", 36, skip=4),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{4}", "[A-Za-z0-9-]", 10, skip=5),
    Rule("jwt", f"eyJ{_WEB}{{4}}", _WEB, 8, skip=3, more=((b".eyJ", 8), (b".", 8))),
    Rule("pem", "-----BEGIN ([A-Z]+ ){0,3}PRIVATE KEY-----"),
)


@cache
def automaton() -> Automaton:
    return compile_rules([r.head for r in RULES])


@cache
def _backwards(rule: int) -> Automaton:
    return compile_reversed(RULES[rule].head)


@cache
def _class(runs: str) -> np.ndarray:
    """Which bytes are in a class."""
    out, a = np.zeros(256, bool), compile_reversed(runs)
    for b in range(256):
        out[b] = bool(a.found[a.step[a.start * a.n_classes + a.byte_class[b]]])
    return out


def _rule_spans(r: int, hits: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first byte, last byte + 1) of the spans of rule r. hits: where its head ends, sorted."""
    rule = RULES[r]
    outside = np.flatnonzero(~_class(rule.runs)[raw]) if rule.runs else np.zeros(0, np.int64)

    def run_end(at: int, limit: int) -> int:
        i = int(np.searchsorted(outside, at))
        return min(limit, int(outside[i])) if i < len(outside) else limit

    i, row, taken = 0, -1, 0  # taken: the end of what was matched before
    while i < len(hits):
        p = int(hits[i])
        if row < 0 or p >= offsets[row + 1]:
            row = int(np.searchsorted(offsets, p, "right")) - 1
            taken = int(offsets[row])
        limit = int(offsets[row + 1])
        begin = first_byte(_backwards(r), raw, int(offsets[row]), p)
        if rule.back:
            j = int(np.searchsorted(outside, begin)) - 1
            begin = max(int(offsets[row]), int(outside[j]) + 1 if j >= 0 else 0)
        if begin < taken:
            i += 1
            continue
        end = run_end(p, limit) if rule.runs else p + 1
        good = end - (p if rule.skip is None else begin + rule.skip) >= rule.least
        own_end = end
        for text, least in rule.more:
            follows = raw[end : end + len(text)].tobytes() == text and end + len(text) <= limit
            after = run_end(end + len(text), limit) if follows else end
            good = good and follows and after - end - len(text) >= least
            end = after
        if good:
            yield row, begin, end
        if good or rule.base:
            taken = end
            i = int(np.searchsorted(hits, end))
        elif rule.more and end == own_end:
            i = int(np.searchsorted(hits, end))  # whatever else begins in this run ends with it, and nothing follows
        else:
            i += 1


def find_block(raw: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Row -> sorted (start, rule, end) in code points, for rows that have spans."""
    at, bits = scan(automaton(), raw, offsets)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for r in range(len(RULES)):
        for row, begin, end in _rule_spans(r, np.sort(at[bits >> r & 1 == 1]), raw, offsets):
            found.setdefault(row, []).append((begin, r, end))
    out = {}
    for row, spans in found.items():
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        # bytes that begin a character, counted once for the row
        points = np.concatenate([[0], np.cumsum((raw[lo:hi] & 0xC0) != 0x80)])
        out[row] = sorted((int(points[a - lo]), r, int(points[b - lo])) for a, r, b in spans)
    return out


def find_text(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return [(RULES[r].kind, s, e) for s, r, e in find_block(raw, np.array([0, len(raw)], np.int64)).get(0, [])]


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and spans: array<struct<kind, start, end, base>> by start, then rule, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            spans: list[list] = []
            for lo, hi, raw, offsets in text_blocks(batch.column(1), BLOCK_BYTES):
                found = find_block(raw, offsets)
                spans += [[(RULES[r].kind, s, e, RULES[r].base) for s, r, e in found.get(i, ())] for i in range(hi - lo)]
            made = pa.array([[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in row] for row in spans], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "spans"])

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
