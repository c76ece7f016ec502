"""Scores texts with a bigram model that lives in a log-frequency Bloom filter.

Counting. Each Arrow block of training texts is reduced to its distinct words and word
pairs (64-bit fingerprints) with counts; they are dealt out by fingerprint and added up
exactly over the whole corpus. Each bucket turns its counts into a shard of the filter:
an n-gram with quantised count q = 1 + floor(log(c) / log(GROWTH)) is inserted
once for each level 1..q, words and pairs alike from a count of 1 on. Each entry gets
BITS_PER_ENTRY bits, so the filter grows with the corpus.

Scoring. For each distinct word and pair of a block the filter is probed for level 1, 2,
... until a probe fails; the last level gives the count. p(w | v) is
lambda c(v w) / c(v) + (1 - lambda) (c(w) + 1) / (N + V + 1); lambda depends on the size of
c(v) and is fitted by EM on all training documents, each with the counts that its pairs have
in all others: what the filter says less the document's own. Counts up to 3 are exact in the
filter; pairs that stand at least LONE_FROM times in one document and in no other are marked
in it, so "in no other" is exact for all counts.

Up to BROADCAST_BYTES the filter goes to all workers in one piece. A larger one stays in
its shards: blocks of texts are written, their distinct n-grams are sent to the shard that
holds them, probed there, and the levels (a byte each) come back to the block. Both ways
probe the same bits, so scores are the same.

Each block is looked up once: the levels of its tokens (two bytes a token) are written, with
counts of what EM needs; once the weights are known, scores are made of the levels alone.

The base score needs exact counts. Those of the most frequent words (at most HOT) go to
the workers; occurrences of all others are joined to the count table by fingerprint. So
no join key is frequent, and what is shuffled is a small part of the corpus.

Defined cases: a null or empty text has one token, the end; texts of any length are read
whole; repeated rows and doc_ids, and null doc_ids, are scored (and counted) as often as
they occur, but tune once, without their copies; with no training rows N and V are 0; an empty table gives an
empty one; other columns, whatever they are called, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_split, release, stored
from .hashing import combine, mix, text_blocks, text_bytes, word_hashes, word_spans

#: Counts are added up in 2**bits buckets by the first bits of a fingerprint: LEAST_BITS, or more, so that a bucket gets about BUCKET_BYTES of text.
LEAST_BITS, MOST_BITS, BUCKET_BYTES = 8, 20, 16_000_000
GROWTH = 1.5
BITS_PER_ENTRY = 8
PROBES = 4
HOT = 300_000
BLOCK_BYTES = 1_000_000
MAX_LEVEL = 80
#: Requests to the shards of a larger filter are sent in so many rounds, each to a range of shards: only one round's are on disk at a time.
ROUNDS = 2
#: Filters up to this size are broadcast.
BROADCAST_BYTES = 1 << 28
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Marks keys of pairs in the filter; the first bits, which name the bucket, stay.
_PAIR = np.uint64(0x0000002E3D27D4EB)
#: Marks keys of pairs that one document alone holds, and holds so often that the filter does not give the exact count.
_LONE, LONE_FROM = np.uint64(0x00000071C94B06D5), 4
#: Up to so many rows that repeat, their numbers are broadcast.
FEW_REPEATED = 100_000
_STEP = np.uint64(0x9FB21C651E98DF25)


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows (words, then one end each), the token before each, and row offsets."""
    start, end, first = word_spans(raw, offsets)
    words, n = word_hashes(raw, start, end), len(offsets) - 1
    at = first + np.arange(n + 1)
    tokens = np.empty(len(words) + n, np.uint64)
    last = np.zeros(len(tokens), bool)
    last[at[1:] - 1] = True
    tokens[last], tokens[~last] = _END, words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at[:-1]] = _START
    return tokens, before, at


def _pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Keys of pairs; the lowest byte is 0, so that seven bytes tell a key."""
    return combine(before, tokens) & ~np.uint64(0xFF)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _own(pairs: np.ndarray, at: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For each pair of texts (row offsets: at) how often its text and the copies of it hold it; 0 for texts that are not learned from (0 copies)."""
    row = np.repeat(np.arange(len(copies)), np.diff(at))
    distinct, where = np.unique(pairs, return_inverse=True)
    _, which, n = np.unique(row * np.int64(len(distinct)) + where, return_inverse=True, return_counts=True)
    return n[which] * copies[row]


def _dealt(kind: int, distinct: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple[int, int, bytes, bytes]]:
    """Sorted keys with counts, cut by bucket: eight bytes a word, seven a pair. kind: 0 words, 1 pairs, 2 pairs with how often one document and its copies hold them."""
    own = _bucket(distinct, bits)
    edges = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
    small = distinct.view(np.uint8).reshape(-1, 8)
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        out.append((int(own[lo]), kind, np.ascontiguousarray(small[lo:hi, int(kind > 0) :]).tobytes(), counts[lo:hi].astype(np.uint32).tobytes()))
    return out


def _wide(data: bytes) -> np.ndarray:
    """Keys of pairs from their seven bytes."""
    seven = np.frombuffer(data, np.uint8).reshape(-1, 7)
    out = np.zeros((len(seven), 8), np.uint8)
    out[:, 1:] = seven
    return out.view(np.uint64).reshape(-1)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.int64)


def _level(counts: np.ndarray, least: int = 1) -> np.ndarray:
    return np.minimum(MAX_LEVEL, 1 + np.floor(np.log(counts / least) / math.log(GROWTH) + 1e-9)).astype(np.int64)


def _decoded(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for; level 0 is none."""
    least, over = np.ceil(GROWTH ** (levels - 1.0) - 1e-9), np.ceil(GROWTH**levels - 1e-9)
    return np.where(levels > 0, (least + over - 1) / 2, 0.0)


_COUNTS = _decoded(np.arange(MAX_LEVEL + 1))


def _places(keys: np.ndarray, level: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    h = mix(keys + np.array(level, np.uint64) * _STEP)
    stride = mix(h) | np.uint64(1)
    size = np.asarray(bits).astype(np.uint64)
    for i in range(PROBES):
        yield (h + np.uint64(i) * stride) % size


def _shard(words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, most_bytes: int | None = None, per_entry: int = BITS_PER_ENTRY, lone: np.ndarray | None = None) -> bytes:
    lone = np.zeros(0, np.uint64) if lone is None else lone
    keys = np.concatenate([words, pairs ^ _PAIR, lone ^ _LONE])
    levels = np.concatenate([_level(word_counts), _level(pair_counts), np.ones(len(lone), np.int64)])
    n_bytes = int(levels.sum()) * per_entry // 8 + 8
    n_bytes = n_bytes if most_bytes is None else min(most_bytes, n_bytes)
    held = np.zeros(n_bytes * 8, bool)
    level = 1
    while len(keys):
        for at in _places(keys, level, n_bytes * 8):
            held[at] = True
        keep = levels > level
        keys, levels, level = keys[keep], levels[keep], level + 1
    return np.packbits(held, bitorder="little").tobytes()


def _probed(data: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels of keys in a filter. begin, size: for each key the first byte of its shard and the shard's bits."""
    out = np.zeros(len(keys), np.int64)
    todo = np.flatnonzero(size > 0)
    for level in range(1, MAX_LEVEL + 1):
        if not len(todo):
            break
        found = np.ones(len(todo), bool)
        for at in _places(keys[todo], level, size[todo]):
            at = at.astype(np.int64)
            found &= (data[begin[todo] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        todo = todo[found]
        out[todo] = level
    return out


@dataclass
class Model:
    """What workers get. bits: all shards one after the other, or None if they stay where they are; at: their first bytes; hot: frequent words, sorted."""

    bits: bytes | None
    at: np.ndarray
    train_tokens: int
    vocabulary: int
    hot: np.ndarray
    hot_counts: np.ndarray
    weights: np.ndarray

    @property
    def bucket_bits(self) -> int:
        return (len(self.at) - 1).bit_length() - 1

    def levels(self, keys: np.ndarray) -> np.ndarray:
        own = _bucket(keys, self.bucket_bits)
        begin = self.at[own]
        return _probed(np.frombuffer(self.bits, np.uint8), begin, (self.at[own + 1] - begin) * 8, keys)

    def parts(self, levels: np.ndarray, together: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token of texts (row offsets: at): pair probability, word probability, and the size class of the word before. levels: of the tokens; together: counts of the pairs."""
        counts = _COUNTS[levels]
        word = (counts + 1) / (self.train_tokens + self.vocabulary + 1)
        history, size = np.zeros(len(levels)), np.zeros(len(levels), np.int64)
        history[1:], size[1:] = counts[:-1], levels[:-1]
        history[at[:-1]] = counts[at[1:] - 1]  # as many texts begin as end
        size[at[:-1]] = 0
        pair = np.minimum(1.0, together / np.maximum(history, np.maximum(together, 1.0)))
        return pair, word, np.minimum(size, len(self.weights) - 1)


def _count(docs: DataFrame, bits: int) -> DataFrame:
    """docs: text, copies. One row per bucket: counts of words (two blobs) and a shard of the filter."""

    per_entry = BITS_PER_ENTRY

    def block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = batch.column(1).to_numpy()
            for lo, hi, raw, offsets in text_blocks(batch.column(0), BLOCK_BYTES):
                tokens, before, at = _tokens(raw, offsets)
                pairs = _pairs(before, tokens)
                own = _own(pairs, at, copies[lo:hi])
                often = np.flatnonzero(own >= LONE_FROM)
                often = often[np.argsort(pairs[often], kind="stable")]
                often = often[np.append(True, (np.diff(pairs[often]) != 0) | (np.diff(own[often]) != 0))[: len(often)]]
                rows = _dealt(0, *np.unique(tokens, return_counts=True), bits) + _dealt(1, *np.unique(pairs, return_counts=True), bits) + _dealt(2, pairs[often], own[often], bits)
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "keys", "counts"])

    def merged(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        keys, counts = ([], [], [np.zeros(0, np.uint64)]), ([], [], [np.zeros(0, np.uint32)])
        for kind, k, c in zip(group.column("kind").to_pylist(), group.column("keys").to_pylist(), group.column("counts").to_pylist(), strict=True):
            keys[kind].append(_wide(k) if kind else np.frombuffer(k, np.uint64))
            counts[kind].append(np.frombuffer(c, np.uint32))
        words, word_counts = _added(keys[0], counts[0])
        pairs, pair_counts = _added(keys[1], counts[1])
        often = np.concatenate(keys[2])
        lone = np.unique(often[pair_counts[np.searchsorted(pairs, often)] == np.concatenate(counts[2])])
        shard = _shard(words, word_counts, pairs, pair_counts, per_entry=per_entry, lone=lone)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "words": pa.array([words.tobytes()], pa.binary()), "counts": pa.array([word_counts.tobytes()], pa.binary()), "shard": pa.array([shard], pa.binary()), "tokens": pa.array([int(word_counts.sum())], pa.int64()), "vocabulary": pa.array([len(words)], pa.int64())})

    dealt = docs.mapInArrow(block_counts, "bucket int, kind int, keys binary, counts binary")
    return dealt.groupBy("bucket").applyInArrow(merged, "bucket int, words binary, counts binary, shard binary, tokens long, vocabulary long")


def _word_counts(buckets: DataFrame) -> DataFrame:
    """word (fingerprint as long), c."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words.as_py(), np.int64)), pa.array(np.frombuffer(counts.as_py(), np.int64))], ["word", "c"])

    return buckets.select("words", "counts").mapInArrow(opened, "word long, c long")


_RATIOS = np.arange(-12, 13)


def _fit_weights(seen: DataFrame, n_classes: int) -> np.ndarray:
    """EM over counts of (size class of the word before, log2 of pair over word probability) in all training rows; a row and its copies count once."""
    total = np.zeros((n_classes, len(_RATIOS) + 1))
    for r in sorted(seen.select(F.inline("tuning")).groupBy("copies", "size", "ratio").agg(F.sum("n").alias("n")).collect()):
        total[r["size"], r["ratio"]] += r["n"] / r["copies"]
    value = np.concatenate([[0.0], 2.0**_RATIOS])
    weights = np.full(n_classes, 0.1)
    total[:, 0] += 1  # so that a class of few tokens stays near 0
    for _ in range(60):
        posterior = weights[:, None] * value / (weights[:, None] * value + (1 - weights[:, None]))
        weights = np.clip((total * posterior).sum(axis=1) / total.sum(axis=1), 1e-6, 0.95)
    return weights


@dataclass
class Fitted:
    """counts: word, c. shards: bucket, shard (of the filter). seen: what _looked_up says of the rows of source (a table, its columns of text and key)."""

    model: Model
    counts: DataFrame
    shards: DataFrame
    source: tuple[DataFrame, str, str]
    seen: DataFrame | None = None


def _rows(docs: DataFrame, text: str, key: str, training: F.Column) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("trained"))


def fit(docs: DataFrame, training: F.Column, text: str = "text", key: str = "doc_id") -> Fitted:
    """Learns from the rows of docs for which training holds. All rows are looked up, those for the weights; score() of the same table takes them from there."""
    rows = _rows(docs, text, key, training).withColumn("same", F.xxhash64("doc_id", "text", F.lit(7)))
    same = rows.where("trained").groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    n_rows, n_bytes, n_repeated = same.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(n_bytes / BUCKET_BYTES + 1))))
    if n_repeated > FEW_REPEATED:
        rows = join_split(rows.where("trained"), same.select("same", "n"), "same", "n", n_rows).unionByName(rows.where("not trained").withColumn("n", F.lit(0).cast("long")))
    elif n_repeated:
        rows = rows.join(F.broadcast(same.where("n > 1").select("same", "n")), "same", "left")
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    rows = rows.select("doc_id", "text", F.when(F.col("trained"), F.coalesce("n", F.lit(1))).otherwise(0).cast("long").alias("copies"))
    buckets = stored(_count(rows.where("copies > 0").select("text", "copies"), bits), "ngrams")
    counts = _word_counts(buckets)
    sums = buckets.agg(F.sum("tokens").alias("n"), F.sum("vocabulary").alias("v"), F.sum(F.octet_length("shard").cast("long")).alias("bytes")).first()
    size = F.floor(F.log2("c")).cast("int")
    hot_from, so_far = 64, 0
    for r in sorted(counts.groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.s):
        so_far += r.n
        if so_far > HOT:
            break
        hot_from = r.s
    hot = counts.where(size >= hot_from).toArrow()
    hot_words, hot_counts = hot.column(0).to_numpy().view(np.uint64), hot.column(1).to_numpy()
    order = np.argsort(hot_words)
    del hot
    shards = buckets.select("bucket", "shard")
    model = Model(None, np.zeros((1 << bits) + 1, np.int64), int(sums.n or 0), int(sums.v or 0), hot_words[order], hot_counts[order], np.full(40, 0.1))
    release(docs.sparkSession)  # the files of the counts' shuffle
    if (sums.bytes or 0) <= BROADCAST_BYTES:
        found = shards.toArrow()
        by_bucket = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
        del found
        np.cumsum([len(by_bucket.get(b, b"")) for b in range(1 << bits)], out=model.at[1:])
        model.bits = b"".join(by_bucket.get(b, b"") for b in range(1 << bits))
        del by_bucket
    fitted = Fitted(model, counts, shards, (docs, text, key))
    fitted.seen = _looked_up(rows, fitted)
    model.weights = _fit_weights(fitted.seen, len(model.weights))
    return fitted


_SEEN = "row_id array<long>, doc_id array<long>, n_tokens array<long>, known array<long>, base array<double>, levels binary, pair_levels binary, rare_at binary, rare binary, rare_n binary, tuning array<struct<copies: long, size: long, ratio: long, n: long>>"
_SEEN_NAMES = [c.split(" ")[0] for c in _SEEN.split(", ")[:10]] + ["tuning"]
_TUNING_NAMES = ["copies", "size", "ratio", "n"]
_SCHEMA = "row_id long, doc_id long, word long, n long, head boolean, n_tokens long, known long, base double, score double"
_NAMES = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def _tuning(model: Model, pairs: np.ndarray, levels: np.ndarray, pair_levels: np.ndarray, at: np.ndarray, copies: np.ndarray, levels_of) -> list[np.ndarray]:
    """For the texts of a block that are learned from, how many tokens have which copies, size class and ratio of probabilities, pairs counted in all other texts."""
    own = _own(pairs, at, copies)
    outside = np.maximum(_COUNTS[pair_levels] - own, pair_levels >= LONE_FROM)  # levels up to 3 are counts; of more, all but the lone have others
    may = np.flatnonzero(own >= LONE_FROM)
    may = may[_level(own[may]) >= pair_levels[may]]
    outside[may[levels_of(pairs[may] ^ _LONE) > 0]] = 0
    pair, word, size = model.parts(levels, outside, at)
    with np.errstate(divide="ignore"):
        ratio = np.where(pair > 0, np.clip(np.round(np.log2(pair / word)), -12, 12) + 13, 0).astype(np.int64)
    cell, token_copies, width = size * (len(_RATIOS) + 1) + ratio, np.repeat(copies, np.diff(at)), len(model.weights) * (len(_RATIOS) + 1)
    out = []
    for many in np.unique(copies[copies > 0]):
        n = np.bincount(cell[token_copies == many], minlength=width)
        held = np.flatnonzero(n)
        out.append((np.full(len(held), many), held // (len(_RATIOS) + 1), held % (len(_RATIOS) + 1), n[held]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


def _seen(model: Model, row_id: pa.Array, doc_id: pa.Array, copies: np.ndarray, raw: np.ndarray, offsets: np.ndarray, levels_of) -> pa.RecordBatch:
    """One row for a block of texts: all that scores are made of once the weights are known. rare: words whose exact count is not at hand, rare_at: their texts."""
    spread = math.log10(model.train_tokens + model.vocabulary + 1)
    tokens, before, at = _tokens(raw, offsets)
    n_tokens, m = np.diff(at), len(offsets) - 1
    distinct, where = np.unique(tokens, return_inverse=True)
    pairs, pair_where = np.unique(_pairs(before, tokens), return_inverse=True)
    levels, pair_levels = levels_of(distinct)[where], levels_of(pairs ^ _PAIR)[pair_where]
    tuning = _tuning(model, pairs[pair_where], levels, pair_levels, at, copies, levels_of)
    place = np.searchsorted(model.hot, distinct)
    place[place == len(model.hot)] = 0
    is_hot = model.hot[place] == distinct if len(model.hot) else np.zeros(len(distinct), bool)
    exact = np.where(is_hot, np.log10((model.hot_counts[place] if len(model.hot) else 0) + 1.0), 0.0)
    row = np.repeat(np.arange(m), n_tokens)
    known = np.bincount(row, is_hot[where], m).astype(np.int64)
    base = np.bincount(row, exact[where], m) - n_tokens * spread
    rare = np.flatnonzero(~is_hot[where])
    both, n = np.unique(row[rare] * np.int64(len(distinct)) + where[rare], return_counts=True)
    lists = [row_id, doc_id, pa.array(n_tokens.astype(np.int64)), pa.array(known), pa.array(base)]
    blobs = [levels.astype(np.uint8), pair_levels.astype(np.uint8), (both // len(distinct)).astype(np.int32), distinct[both % len(distinct)], n.astype(np.int32)]
    whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
    tuned = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in tuning], _TUNING_NAMES)
    return pa.RecordBatch.from_arrays([*map(whole, lists), *(pa.array([b.tobytes()], pa.binary()) for b in blobs), whole(tuned)], _SEEN_NAMES)


def _by_broadcast(rows: DataFrame, model: Model) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            copies = batch.column(2).to_numpy()
            for lo, hi, raw, offsets in text_blocks(batch.column(3), BLOCK_BYTES):
                yield _seen(model, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), copies[lo:hi], raw, offsets, model.levels)

    out = stored(rows.mapInArrow(run, _SEEN), "levels")
    held.destroy()
    return out


def _asked(raw: np.ndarray, offsets: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """All n-grams of a block that its scores and the weights need, sorted."""
    tokens, before, at = _tokens(raw, offsets)
    pairs = _pairs(before, tokens)
    keys = np.sort(np.concatenate([tokens, pairs ^ _PAIR, pairs[_own(pairs, at, copies) >= LONE_FROM] ^ _LONE]))
    return keys[np.append(True, keys[1:] != keys[:-1])]  # np.unique hashes first, which takes several times as long


def _answers(data: np.ndarray, requests: pa.Array) -> pa.Array:
    """Levels (a byte each) for the keys of each request to a shard. Blocks ask for the same n-grams and for few at a time: requests are probed together, each key once."""
    offsets = np.frombuffer(requests.buffers()[1], np.int32)[requests.offset : requests.offset + len(requests) + 1]
    keys = np.frombuffer(requests.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64) if len(requests) and offsets[-1] > offsets[0] else np.zeros(0, np.uint64)
    distinct, where = np.unique(keys, return_inverse=True)
    levels = _probed(data, np.zeros(len(distinct), np.int64), np.full(len(distinct), len(data) * 8), distinct).astype(np.uint8)[where]
    at = (offsets - offsets[0]) // 8 if len(requests) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.binary(), len(requests), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(levels.tobytes())])


def _by_shards(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """The same without a worker that holds the whole filter: n-grams go to their shards, levels come back."""
    model = fitted.model
    bits, most = model.bucket_bits, BLOCK_BYTES
    held = rows.sparkSession.sparkContext.broadcast(model)  # without its filter

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in text_blocks(batch.column(3), most):
                part = batch.slice(lo, hi - lo)
                whole = pa.array([0, hi - lo], pa.int32())
                texts = part.column(3).fill_null("").cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), *(pa.ListArray.from_arrays(whole, c) for c in (part.column(0), part.column(1), part.column(2), texts))], ["block", "row_id", "doc_id", "copies", "text"])

    blocks = stored(rows.mapInArrow(cut, "block long, row_id array<long>, doc_id array<long>, copies array<long>, text array<string>"), "blocks")

    def ask_in(lowest: int, highest: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    keys = _asked(*text_bytes(batch.column(1)[i].values), batch.column(2)[i].values.to_numpy())
                    own = _bucket(keys, bits)
                    first, last = np.searchsorted(own, (lowest, highest))
                    keys, own = keys[first:last], own[first:last]
                    edges = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
                    parts = [keys[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(parts), pa.int64()), pa.array(own[edges[:-1]].astype(np.int32)), pa.array(parts, pa.binary())], ["block", "bucket", "keys"])

        return ask

    def probe(requests: pa.Table, shard: pa.Table) -> pa.Table:
        data = np.frombuffer(shard.column("shard")[0].as_py(), np.uint8) if shard.num_rows else np.zeros(0, np.uint8)
        keys = requests.column("keys")
        return pa.table({"block": requests.column("block"), "bucket": requests.column("bucket"), "levels": pa.chunked_array([_answers(data, c) for c in keys.chunks], pa.binary())})

    told = []
    for lowest, highest in zip(edges := [(1 << bits) * i // ROUNDS for i in range(ROUNDS + 1)], edges[1:], strict=False):
        requests = blocks.select("block", "text", "copies").mapInArrow(ask_in(lowest, highest), "block long, bucket int, keys binary")
        told.append(stored(requests.groupBy("bucket").cogroup(fitted.shards.where(F.col("bucket").between(lowest, highest - 1)).groupBy("bucket")).applyInArrow(probe, "block long, bucket int, levels binary"), "levels", merged=True))
        told[-1].count()  # Spark holds on to the last step it ran; with another one behind it, the files of the requests can go
        release(rows.sparkSession)
    answers = stored(reduce(DataFrame.unionAll, told).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "levels"))).alias("answers")), "answers", merged=True)
    for part in told:
        discard(part)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                raw, offsets = text_bytes(batch.column(3)[i].values)
                copies = batch.column(5)[i].values.to_numpy()
                keys = _asked(raw, offsets, copies)
                # buckets are ranges of keys, so their answers stand in the order of the keys
                levels = np.frombuffer(b"".join(a["levels"] for a in batch.column(4)[i].as_py()), np.uint8).astype(np.int64)
                yield _seen(model, batch.column(1)[i].values, batch.column(2)[i].values, copies, raw, offsets, lambda k, keys=keys, levels=levels: levels[np.searchsorted(keys, k)])

    out = stored(blocks.join(answers, "block").select("block", "row_id", "doc_id", "text", "answers", "copies").mapInArrow(finish, _SEEN), "levels")
    held.destroy()
    for part in (blocks, answers):
        discard(part)
    release(rows.sparkSession)  # the files of the texts' shuffle
    return out


def _looked_up(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """rows: doc_id, text, copies. What _seen says of them, written."""
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "copies", "text")
    return _by_shards(rows, fitted) if fitted.model.bits is None else _by_broadcast(rows, fitted.model)


def _scored(seen: DataFrame, model: Model) -> DataFrame:
    """One row (head) for each text, and one for each of its words whose exact count is not at hand."""
    small = replace(model, bits=None, hot=None, hot_counts=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row_id, doc_id, n_tokens, known, base = (batch.column(c)[i].values for c in range(5))
                levels, pair_levels, rare_at, rare, rare_n = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip(range(5, 10), (np.uint8, np.uint8, np.int32, np.int64, np.int32), strict=True))
                m, ids, at = len(row_id), row_id.to_numpy(), np.append(0, np.cumsum(n_tokens.to_numpy()))
                pair, word, size = small.parts(levels, _COUNTS[pair_levels], at)
                weight = small.weights[size]
                total = np.bincount(np.repeat(np.arange(m), np.diff(at)), np.log10(weight * pair + (1 - weight) * word), m)
                yield pa.RecordBatch.from_arrays([row_id, doc_id, pa.array(mix(ids.view(np.uint64)).view(np.int64)), pa.array(np.zeros(m, np.int64)), pa.array(np.ones(m, bool)), n_tokens, known, base, pa.array(total)], _NAMES)
                if k := len(rare):
                    none = [pa.nulls(k, t) for t in _KINDS]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rare_at]), none[1], pa.array(rare), pa.array(rare_n.astype(np.int64)), pa.array(np.zeros(k, bool)), *none[5:]], _NAMES)

    return seen.drop("tuning").mapInArrow(run, _SCHEMA)


def score(docs: DataFrame, fitted: Fitted, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    if docs is fitted.source[0] and (text, key) == fitted.source[1:]:
        seen = fitted.seen
    else:
        seen = _looked_up(_rows(docs, text, key, F.lit(False)).select("doc_id", "text", F.lit(0).cast("long").alias("copies")), fitted)
    parts = _scored(seen, fitted.model)
    joined = parts.join(fitted.counts, "word", "left")
    exact = F.when(~F.col("head"), F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).otherwise(F.col("base"))
    known = F.when(~F.col("head"), F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("known"))
    return (
        joined.select("row_id", "doc_id", "n_tokens", known.alias("known"), exact.alias("base"), "score")
        .groupBy("row_id")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.lit(fitted.model.train_tokens).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.max("score").alias("score"))
        .drop("row_id")
    )
