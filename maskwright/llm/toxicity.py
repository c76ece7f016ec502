"""Toxicity by compression distance between zstandard dictionaries of toxic and of ordinary text.

Training, in one task, on a bounded sample of labelled rows:

1. a base dictionary is trained on the ordinary texts;
2. every window of the ordinary texts is compressed with it. A window is hard if it takes
   at least as many bytes as HARD of the ordinary windows of its length do: a threshold
   for each window length. A second dictionary is trained on the hard ordinary windows;
3. with both, hard windows are told anew, and a third dictionary is trained on those of
   the toxic texts. The ordinary compressor holds the first two, the toxic one all three.

A window's margin is its length under the ordinary compressor minus that under the toxic
one. A document's largest margin, the mean of its three largest and of its eight largest
give a probability by a logistic curve, fitted on labelled rows that no dictionary was
trained on; classes weigh by the root of their sizes, between alike and as they come. A
document is toxic from 0.5 on.

A window is one word with its borders. Compressors count whole bytes, and a short window
has few: each character is therefore spread to SPREAD bytes that depend on it and the one
before it (texts and dictionaries alike), so that what a dictionary does not hold costs
SPREAD bytes a character and a match costs about three.

Every window of every text is compressed; equal windows of a block of texts once, and
what a worker has met lately is looked up. Labels,
language, source and doc_id are never inputs of a score.

Bounds of the sample: MAX_TOXIC and MAX_ORDINARY rows for the dictionaries and
MAX_CALIBRATION rows of each class for the curve, by a hash of doc_id, in that order as
long as their texts have at most SAMPLE_BYTES together (whole texts; at least one).

Defined cases: null and empty texts have no window and margins 0, and get the score of
that; texts of any length are read whole; with no labelled row of either class all scores
are 0; several labels of one doc_id count as their maximum, null labels and null doc_ids
are left out; of rows that share a doc_id the one with the shortest text is learned from,
and all are scored; an empty table gives an empty one; other columns are ignored (score) or pass through (keep_ordinary).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod
from .hashing import text_blocks, text_bytes, word_hashes, word_spans

MAX_TOXIC = 2_000
MAX_ORDINARY = 6_000
#: Labelled rows of each class on which the score is calibrated.
MAX_CALIBRATION = 1_500
#: Texts of the sample, in bytes, for each class and use.
SAMPLE_BYTES = 32 << 20
#: Largest sizes of the three dictionaries, and the pieces that training puts together.
BASE_SIZE, ORDINARY_SIZE, TOXIC_SIZE = 1 << 15, 1 << 15, 1 << 13
BASE_PIECE, HARD_PIECE = 64, 24
#: Share of ordinary windows of a length that are not hard.
HARD = 0.9
#: Windows of a length that a threshold of its own needs.
RARE = 30
SPREAD = 4
#: Window lengths from here on share a threshold.
MAX_WINDOW = 60
TOP = 8
BLOCK_BYTES = 1_000_000
#: Windows that are compressed by one call, and whose margins a worker keeps.
CALL, MEMO = 100_000, 1_000_000
_SPACE = 32


def spread(data: np.ndarray) -> np.ndarray:
    """SPREAD bytes for each byte, from it and the one before it; a space always gives the same."""
    a = data.astype(np.uint64)
    before = np.concatenate([np.array([_SPACE], np.uint64), a[:-1]])
    before[a == _SPACE] = 0
    h = (a * np.uint64(256) + before) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 8 - SPREAD :]).reshape(-1)


@dataclass
class Windows:
    """Distinct windows of some texts, one after the other: data[ends[i - 1] : ends[i]]. which: the distinct window of each word; first: each text's first word (n + 1 values)."""

    data: np.ndarray
    ends: np.ndarray
    which: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.ends)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def of_texts(self, chosen: np.ndarray) -> list[bytes]:
        """For each text that has some the chosen ones of its distinct windows, put together."""
        raw, begins = self.data.tobytes(), self.ends - self.sizes
        pairs = np.unique(np.column_stack([self.text_of, self.which])[chosen[self.which]], axis=0)
        parts = np.split(pairs[:, 1], np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else []
        return [b"".join(raw[begins[i] : self.ends[i]] for i in part) for part in parts]


def laid_out(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a space before and behind each, one after the other, and their ends."""
    sizes = end - start + 2
    ends = np.cumsum(sizes)
    data = np.full(int(ends[-1]) if len(ends) else 0, _SPACE, np.uint8)
    inside = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    word = (inside > 0) & (inside < np.repeat(sizes, sizes) - 1)
    data[word] = raw[(np.repeat(start, sizes) + inside - 1)[word]]
    return data, ends


def windows(raw: np.ndarray, offsets: np.ndarray) -> Windows:
    """raw, offsets: texts in lower case, as text_bytes gives them."""
    start, end, first = word_spans(raw, offsets)
    _, place, which = np.unique(word_hashes(raw, start, end), return_index=True, return_inverse=True)
    return Windows(*laid_out(raw, start[place], end[place]), which, first)


class Compressor:
    """Lengths of windows under a dictionary, without frame headers."""

    def __init__(self, dictionary: bytes):
        import zstandard as z

        how = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, strategy=z.STRATEGY_BTOPT, min_match=3, window_log=22, hash_log=20, chain_log=20, search_log=6, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
        held = z.ZstdCompressionDict(spread(np.frombuffer(dictionary, np.uint8)).tobytes(), dict_type=z.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        self.frames, self.zstd = z.BufferWithSegments, z.ZstdCompressor(dict_data=held, compression_params=how)

    def lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of windows data[ends[i - 1] : ends[i]]."""
        out = np.zeros(len(ends), np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for lo in range(0, len(ends), CALL):
            hi = min(len(ends), lo + CALL)
            a, b = int(begins[lo]), int(ends[hi - 1])
            places = np.column_stack([begins[lo:hi] - a, ends[lo:hi] - begins[lo:hi]]).astype(np.uint64) * np.uint64(SPREAD)
            done = self.zstd.multi_compress_to_buffer(self.frames(spread(data[a:b]).tobytes(), places.tobytes()))
            out[lo:hi] = np.fromiter((len(done[i]) for i in range(hi - lo)), np.int64, hi - lo)
        return out


def trained(samples: list[bytes], size: int, piece: int) -> bytes:
    """A dictionary of zstandard's trainer; of samples too few or too small for it their end, as it is."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=piece, d=8).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def hard_from(sizes: np.ndarray, lengths: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each window size the least compressed length that HARD of the windows (by weight) are under; sizes with fewer than RARE windows have that of the next shorter one."""
    out = np.zeros(MAX_WINDOW + 1, np.int64)
    held = np.minimum(sizes, MAX_WINDOW)
    for n in range(1, MAX_WINDOW + 1):
        here = held == n
        out[n] = out[n - 1]
        if weight[here].sum() >= RARE:
            order = np.argsort(lengths[here], kind="stable")
            share = np.cumsum(weight[here][order]) / weight[here].sum()
            out[n] = lengths[here][order][np.searchsorted(share, HARD)]
    return out


def _texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array([t.lower() for t in texts], pa.string()))


@dataclass(frozen=True)
class Model:
    """What workers need; the sizes of its dictionaries are bounded. weights: None if there was nothing to learn from."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] | None


def train(ordinary: list[str], toxic: list[str]) -> tuple[bytes, bytes]:
    """The contents of the ordinary and of the toxic compressor."""
    base = trained([t.lower().encode() for t in ordinary], BASE_SIZE, BASE_PIECE)
    w_o, w_t = windows(*_texts(ordinary)), windows(*_texts(toxic))
    weight = np.bincount(w_o.which, minlength=len(w_o))

    def hard(dictionary: bytes) -> list[list[bytes]]:
        held = Compressor(dictionary)
        l_o, l_t = held.lengths(w_o.data, w_o.ends), held.lengths(w_t.data, w_t.ends)
        limit = hard_from(w_o.sizes, l_o, weight)
        return [w.of_texts(n >= limit[np.minimum(w.sizes, MAX_WINDOW)]) for w, n in ((w_o, l_o), (w_t, l_t))]

    both = trained(hard(base)[0], ORDINARY_SIZE, HARD_PIECE) + base
    # what comes last is nearest to a window, and cheapest
    return both, trained(hard(both)[1], TOXIC_SIZE, HARD_PIECE) + both


class Scorer:
    """Margins are kept by the word's fingerprint, so a worker compresses a word once until it knows MEMO of them."""

    def __init__(self, model: Model):
        self.model = model
        self.by_ordinary, self.by_toxic = Compressor(model.ordinary), Compressor(model.toxic)
        self.known, self.margin = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def margins(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of distinct words, in the order of their fingerprints."""
        at = np.searchsorted(self.known, words)
        met = at < len(self.known)
        met[met] = self.known[at[met]] == words[met]
        out = np.zeros(len(words), np.int32)
        out[met] = self.margin[at[met]]
        new = ~met
        if new.any():
            data, ends = laid_out(raw, start[new], end[new])
            out[new] = self.by_ordinary.lengths(data, ends) - self.by_toxic.lengths(data, ends)
            if len(self.known) + int(new.sum()) > MEMO:
                self.known, self.margin = words, out
            else:
                both = np.concatenate([self.known, words[new]])
                order = np.argsort(both, kind="stable")
                self.known, self.margin = both[order], np.concatenate([self.margin, out[new]])[order]
        return out

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text the largest margin of its windows, the mean of its three and of its TOP largest; none is under 0."""
        start, end, first = word_spans(raw, offsets)
        words, place, which = np.unique(word_hashes(raw, start, end), return_index=True, return_inverse=True)
        margin = self.margins(raw, start[place], end[place], words)[which]
        n = len(offsets) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        some = np.flatnonzero(margin > 0)
        order = some[np.lexsort((-margin[some], text[some]))]
        begins = np.searchsorted(text[order], np.arange(n))
        rank = np.arange(len(order)) - begins[text[order]]
        top = np.zeros((n, TOP))
        top[text[order][rank < TOP], rank[rank < TOP]] = margin[order][rank < TOP]
        return np.column_stack([top[:, 0], top[:, :3].mean(axis=1), top.mean(axis=1)])

    def scores(self, column: pa.Array) -> np.ndarray:
        """Of the texts of a string column."""
        if self.model.weights is None:
            return np.zeros(len(column))
        out = [np.zeros(0)]
        for lo, hi, _, _ in text_blocks(column, BLOCK_BYTES):  # one block at a time is made lower case
            x = self.features(*_texts(column.slice(lo, hi - lo).fill_null("").to_pylist()))
            z = np.column_stack([np.ones(hi - lo), x]) @ np.array(self.model.weights)
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate(out)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small ridge; classes weigh by the root of their sizes."""
    a = np.column_stack([np.ones(len(x)), x])
    scale = np.maximum(np.sqrt((a**2).mean(axis=0)), 1e-9)
    a = a / scale
    weight = np.where(y == 1, 1 / np.sqrt(y.sum()), 1 / np.sqrt((1 - y).sum()))
    weight *= len(y) / weight.sum()
    w = np.zeros(a.shape[1])
    ridge = 0.05 * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (y - p)) - ridge @ w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w)), slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w / scale)


def learned(rows: list[tuple[str, int, str | None]]) -> Model:
    """rows: (use, label, text); use is 'train' or 'curve'."""
    held = {(use, label): [t or "" for u, y, t in rows if (u, y) == (use, label)] for use in ("train", "curve") for label in (0, 1)}
    if not held["train", 0] or not held["train", 1]:
        return Model(b"", b"", None)
    ordinary, toxic = train(held["train", 0], held["train", 1])
    model = Model(ordinary, toxic, None)
    if not held["curve", 0] or not held["curve", 1]:
        # too few labelled rows for rows of their own: a fixed curve, half-way at a margin of five spread characters
        return Model(ordinary, toxic, (-10.0, 10.0 / (5 * SPREAD), 0.0, 0.0))
    scorer, y = Scorer(model), [0] * len(held["curve", 0]) + [1] * len(held["curve", 1])
    texts = held["curve", 0] + held["curve", 1]
    x = np.concatenate([scorer.features(*_texts(texts[i : i + 256])) for i in range(0, len(texts), 256)])
    return Model(ordinary, toxic, _logistic(x, np.array(y, float)))


def fit(docs: DataFrame, labels: DataFrame, training: F.Column, calibration: F.Column, text: str = "text", key: str = "doc_id") -> Model:
    """training, calibration: conditions on labels' doc_id that pick the rows for dictionaries and for the curve."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where("toxic IN (0, 1)")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(cond & (F.col("toxic") == y)).orderBy(*by_hash).limit(n).select("doc_id", "toxic", F.lit(use).alias("use")) for use, cond, most in (("train", training, (MAX_ORDINARY, MAX_TOXIC)), ("curve", calibration, (MAX_CALIBRATION,) * 2)) for y, n in enumerate(most)]
    chosen = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    met = rows.join(F.broadcast(chosen), "doc_id").groupBy("use", "toxic", "doc_id").agg(F.min(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")).alias("row"))
    order = Window.partitionBy("use", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = met.withColumn("bytes", F.sum("row.size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sample = sample.where((F.col("bytes") <= SAMPLE_BYTES) | (F.col("bytes") == F.col("row.size"))).select("use", "toxic", "row.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        model = learned(sorted(held, key=lambda r: (r[0], r[1], r[2] or "")))
        yield pa.RecordBatch.from_arrays([pa.array([model.ordinary], pa.binary()), pa.array([model.toxic], pa.binary()), pa.array([model.weights], pa.list_(pa.float64()))], ["ordinary", "toxic", "weights"])

    # one task trains: it gets no more than the bounds above
    found = sample.repartition(1).mapInArrow(run, "ordinary binary, toxic binary, weights array<double>").collect()
    if not found:
        return Model(b"", b"", None)
    return Model(bytes(found[0].ordinary), bytes(found[0].toxic), None if found[0].weights is None else tuple(found[0].weights))


_scorers: dict[Model, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """The worker's scorer of this model; one at a time."""
    if model not in _scorers:
        _scorers.clear()
        _scorers[model] = Scorer(model)
    return _scorers[model]


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1)))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_ordinary(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under 0.5. Nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(held.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def fit_on_folds(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows whose crc32(doc_id) mod 5 is not 0: 1 to 3 for the dictionaries, 4 for the curve."""
    return fit(docs, labels, crc_mod("doc_id", 5).isin(1, 2, 3), crc_mod("doc_id", 5) == 4)
