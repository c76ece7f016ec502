"""Personal data in texts: fixed patterns, and a skip-chain CRF that keeps labels consistent.

Nodes of a document's field are its mentions: the spans of the base patterns, whose
label is observed, and free mentions, i.e. other things with an @ or at least seven
digits. Labels are other, email, ip, card and phone. Three kinds of potential:

- node: a log-linear model of a mention's form and the word before it;
- chain: successive mentions of a document;
- skip: mentions far apart that repeat or resemble each other (same last seven digits,
  or same part before the @); each is joined to the next such mention, so edges stay
  linear in the number of mentions.

Loopy sum-product message passing gives each free mention its marginal; mentions with
a label other than `other` at 0.5 or more are added to the base spans.

Training is piecewise, in one task, on at most MAX_MENTIONS mentions of each of at most
MAX_TRAINING documents (by a hash of doc_id, of those that may have mentions; of rows that
share a doc_id the shortest text). Node weights learn from masked base mentions: what
makes a base span of a mention is hidden (HIDDEN), its label stays, so the model learns
what else tells the kinds: digits, form, the word before. Free mentions that resemble no
base mention of their document are examples of other; so is, to a share of PRIOR, a
mention that shows nothing. Classes of examples weigh so that other and the rest are
alike. Free mentions that resemble a base mention teach nothing: what they are, messages
decide. Chain and skip weights come from smoothed counts of base labels that agree.

Defined cases: null and empty texts have no spans; any length is read whole; an empty
table gives an empty one (and a field of no evidence); repeated rows and doc_ids, and null
doc_ids, give a result for each row; of kinds as likely as each other the first counts;
other columns, whatever they are called, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("other", "email", "ip", "card", "phone")
KINDS = LABELS[1:]
MAX_TRAINING, MAX_MENTIONS = 4_000, 64
#: Weight of the example that shows nothing, as a share of all others.
PRIOR = 0.25
SWEEPS = 12

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_FREE_MAIL = re.compile(r"[^\s@]+@[^\s@]+")
_FREE_NUMBER = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9][0-9 ().-]{5,}[0-9](?![0-9A-Za-z])")
_DIGIT = re.compile("[0-9]")
_NOT_DIGITS = re.compile("[^0-9]+")
_LAST_WORD = re.compile(r"([^\W\d_]+)[^\w]*$")

# Words that announce a kind.
_CUES = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "credit", "account"},
    "phone": {"phone", "tel", "call", "fax", "mobile"},
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """What the leftmost non-overlapping search finds, in time linear in the text: from each @ to the left, then right."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and _LOCAL.match(text, begin - 1):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            last = m.end()
            out.append((begin, last))
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), sorted; kind counts in KINDS."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-9:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return out


def free_mentions(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Other things with an @ or at least seven digits, apart from what is taken."""
    found = [m.span() for m in _FREE_MAIL.finditer(text)] if "@" in text else []
    found += [m.span() for m in _FREE_NUMBER.finditer(text) if len(_NOT_DIGITS.sub("", m[0])) >= 7]
    spans = sorted((s, e) for _, s, e in taken)
    starts, reach, top = [s for s, _ in spans], [], 0
    for _, e in spans:
        top = max(top, e)
        reach.append(top)
    out, last = [], 0
    for s, e in sorted(found):
        i = int(np.searchsorted(starts, e)) - 1  # the last taken span that starts before e
        if s >= last and (i < 0 or reach[i] <= s):
            out.append((s, e))
            last = e
    return out


def features(text: str, start: int, end: int) -> list[float]:
    m = text[start:end]
    digits = _NOT_DIGITS.sub("", m)
    n = len(digits)
    before = _LAST_WORD.search(text[max(0, start - 24) : start])
    cue = before[1].lower() if before else ""
    dots = m.split(".")
    return [
        1.0,
        float("@" in m),
        float("@" in m and "." in m.rpartition("@")[2]),
        float(len(dots) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in dots)),
        float(7 <= n <= 8),
        float(9 <= n <= 13),
        float(14 <= n <= 15),
        float(16 <= n <= 19),
        float(n > 19),
        float(16 <= n <= 19 and luhn(digits)),
        float(m[0] == "+"),
        float("(" in m),
        float(bool(re.search("[^0-9 -]", m))),
        *(float(cue in _CUES[k]) for k in KINDS),
    ]


def key(text: str, start: int, end: int) -> str:
    """Mentions with the same key resemble each other."""
    m = text[start:end]
    if "@" in m:
        return "@" + m.partition("@")[0].lower()
    return _NOT_DIGITS.sub("", m)[-7:]


#: Features (by place in features()) that make a base span, for each label.
HIDDEN = {1: (1, 2), 2: (3,), 3: (7, 9), 4: (10,)}


def masked(x: list[float], label: int) -> list[float]:
    return [0.0 if i in HIDDEN[label] else v for i, v in enumerate(x)]


@dataclass(frozen=True)
class Field:
    """node: weights by feature and label; chain, skip: log potentials by label of either end."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def marginals(field: Field, x: np.ndarray, observed: np.ndarray, keys: list[str]) -> np.ndarray:
    """Loopy sum-product beliefs of all mentions of a document. observed: label or -1."""
    n, k = len(x), len(LABELS)
    phi = x @ field.node
    fixed = observed >= 0
    phi[fixed] = -30.0
    phi[fixed, observed[fixed]] = 0.0
    edges = [(i, i + 1, field.chain) for i in range(n - 1)]
    last: dict[str, int] = {}
    for i, word in enumerate(keys):
        if word in last:
            edges.append((last[word], i, field.skip))
        last[word] = i
    if not edges:
        p = np.exp(phi - phi.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    psi = np.stack([e[2] for e in edges])
    there, back = np.zeros((len(edges), k)), np.zeros((len(edges), k))

    def lse(z: np.ndarray, axis: int) -> np.ndarray:
        top = z.max(axis=axis, keepdims=True)
        return np.log(np.exp(z - top).sum(axis=axis)) + top.squeeze(axis)

    def belief() -> np.ndarray:
        out = phi.copy()
        np.add.at(out, b, there)
        np.add.at(out, a, back)
        return out

    for _ in range(SWEEPS):
        now = belief()
        new_there = lse((now[a] - back)[:, :, None] + psi, 1)
        new_back = lse((now[b] - there)[:, None, :] + psi, 2)
        new_there -= lse(new_there, 1)[:, None]
        new_back -= lse(new_back, 1)[:, None]
        moved = max(np.abs(new_there - there).max(), np.abs(new_back - back).max())
        there, back = 0.5 * (there + new_there), 0.5 * (back + new_back)
        if moved < 1e-6:
            break
    now = belief()
    return np.exp(now - lse(now, 1)[:, None])


def find_text(text: str | None, field: Field | None) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind, then start."""
    text = text or ""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    free = free_mentions(text, base) if field is not None else []
    if free:
        nodes = sorted([(s, e, k + 1) for k, s, e in base] + [(s, e, -1) for s, e in free])
        x = np.array([features(text, s, e) for s, e, _ in nodes])
        p = marginals(field, x, np.array([o for _, _, o in nodes]), [key(text, s, e) for s, e, _ in nodes])
        for (s, e, o), q in zip(nodes, p, strict=True):
            if o < 0 and q.argmax() and q.max() >= 0.5:
                out.append((int(q.argmax()) - 1, s, e, False))
    return sorted(out)


def _mentions(text: str | None) -> list[dict]:
    """The first MAX_MENTIONS mentions of a training text."""
    text = text or ""
    base = base_spans(text)
    nodes = sorted([(s, e, k + 1) for k, s, e in base] + [(s, e, 0) for s, e in free_mentions(text, base)])
    return [{"x": features(text, s, e), "label": o, "key": key(text, s, e)} for s, e, o in nodes[:MAX_MENTIONS]]


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Field:
    """Learns from the mentions of at most MAX_TRAINING documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("x", pa.list_(pa.float64())), ("label", pa.int32()), ("key", pa.string())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_mentions(t) for t in batch.column(1).to_pylist()], kind)], ["h", "nodes"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["h"])
        field = train([[(m["x"], m["label"], m["key"]) for m in r["nodes"]] for r in held])
        yield pa.RecordBatch.from_arrays([pa.array([m.reshape(-1).tolist()], pa.list_(pa.float64())) for m in (field.node, field.chain, field.skip)], ["node", "chain", "skip"])

    rows = docs.select(F.xxhash64(docs[key].cast("long")).alias("h"), docs[text].cast("string").alias("text")).where(F.col("text").rlike("@|[0-9]{7}|[0-9]\\.[0-9]|\\+[0-9]"))
    chosen = rows.select("h").distinct().orderBy("h").limit(MAX_TRAINING)
    some = rows.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("row")).select("h", "row.text")
    found = some.mapInArrow(read, "h long, nodes array<struct<x:array<double>,label:int,key:string>>").where(F.size("nodes") > 0)
    # one task learns: it gets no more than the bounds above
    made = found.repartition(1).mapInArrow(learn, "node array<double>, chain array<double>, skip array<double>").collect()
    if not made:
        return train([])
    k = len(LABELS)
    return Field(*(np.array(v).reshape(-1, k) for v in (made[0].node, made[0].chain, made[0].skip)))


def train(documents: list[list[tuple[list[float], int, str]]]) -> Field:
    """documents: for each its mentions in order, as (features, label, key); label 0: a free mention."""
    k, d = len(LABELS), len(features("0000000", 0, 7))
    chain, agree, differ = np.ones((k, k)), 20.0, 1.0
    xs, ys = [], []
    for nodes in documents:
        last: dict[str, int] = {}
        known = {word for _, label, word in nodes if label}
        for i, (x, label, word) in enumerate(nodes):
            if label:
                xs.append(masked(x, label))
                ys.append(label)
                if word in last:
                    agree, differ = agree + (last[word] == label), differ + (last[word] != label)
                last[word] = label
            elif word not in known:
                xs.append(x)
                ys.append(0)
            if i and label and nodes[i - 1][1]:
                chain[nodes[i - 1][1], label] += 1
    node = np.zeros((d, k))
    if xs:
        x, label = np.array([*xs, [1.0] + [0.0] * (d - 1)]), np.array([*ys, 0])
        other = label == 0
        weight = np.ones(len(x))
        weight[-1] = 0.0
        weight[other] *= max(1.0, (~other).sum()) / max(1.0, weight[other].sum())
        weight[-1] = PRIOR * weight.sum()
        weight /= weight.sum()
        y = np.eye(k)[label]
        for _ in range(400):
            z = x @ node
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            node += 2.0 * (x.T @ (weight[:, None] * (y - p)) - 2e-4 * node)
    joint = chain / chain.sum()
    # how much more often than by chance two labels follow each other
    ratio = np.log(joint) - np.log(joint.sum(axis=1))[:, None] - np.log(joint.sum(axis=0))[None, :]
    skip = np.where(np.eye(k, dtype=bool), np.log(agree / differ), 0.0)
    return Field(node, np.clip(ratio, -2, 2), skip)


def find_personal_data(docs: DataFrame, field: Field | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and spans: array<struct<kind, start, end, base>> by kind, then start, for each row of docs."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in find_text(t, field)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
