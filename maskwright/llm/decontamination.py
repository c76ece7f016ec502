"""Finds passages of a benchmark in documents, tolerant of substituted words.

An overlap is a window of min(WINDOW, words of the item) words of an item that stands in
a document with at least SIMILAR of its words in place (no insertions). Fixed masks look
at some positions of a stretch and ignore the others; they are chosen so that every
window with as many substitutions as allowed holds a hit of one of them (a cover by
greedy choice, checked over all patterns), so no overlap is missed. Hashes of the masked
words of items and documents are joined; each hit fixes a diagonal, along which all
windows are compared word by word.

The item side goes to the workers in slices of at most SLICE_WORDS words: one slice, one
pass over the documents, so what is broadcast is bounded and larger benchmarks take more
passes. Equal items are one text there, so a text of many items is no larger than one.
Documents are read once per pass and never shuffled.

Defined cases: null and empty documents and items have no words and match nothing; empty
tables give an empty one (of items) or all documents (drop_contaminated); items shorter
than WINDOW must match whole (in SIMILAR of their words); texts of any length are compared
whole; repeated rows give repeated results; equal items are reported each; of stretches
with as many words in place the first one counts; null ids are kept (documents) or -1
(items); other columns of any name are ignored or pass through. Words are as everywhere here: runs of
non-space bytes, A-Z lowered.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .hashing import mix, text_blocks, text_bytes, word_hashes, word_spans

WINDOW = 13
SIMILAR = 0.8
SLICE_WORDS = 2_000_000
BLOCK_BYTES = 4_000_000
#: Words a mask may span, and masks for one window length.
SPAN, MASKS = 10, 2
_TABLE_BITS = 22


def needed(window: int) -> int:
    """Words that must be in place."""
    return -int(-(SIMILAR * window - 1e-9) // 1)


@cache
def masks(window: int) -> tuple[tuple[int, ...], ...]:
    """Masks of the largest weight of which MASKS cover all patterns of allowed substitutions."""
    lost = window - needed(window)
    patterns = [frozenset(c) for c in itertools.combinations(range(window), lost)]
    for weight in range(min(window - lost, SPAN), 0, -1):
        shapes = []
        for span in range(weight, min(window, SPAN) + 1):
            inner = [()] if weight == 1 else itertools.combinations(range(1, span - 1), weight - 2) if weight > 1 else []
            shapes += [(0,)] if weight == 1 and span == 1 else [(0, *c, span - 1) for c in inner] if weight > 1 else []
        covers = {s: {i for i, p in enumerate(patterns) if any(not any(x + o in p for x in s) for o in range(window - s[-1]))} for s in shapes}
        left, chosen = set(range(len(patterns))), []
        while left and len(chosen) < MASKS:
            best = max(shapes, key=lambda s: (len(covers[s] & left), -s[-1], s))
            chosen.append(best)
            left -= covers[best]
        if not left:
            return tuple(chosen)
    raise ValueError("no cover")


def _masked(words: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """A hash of the masked words at each place where the mask fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(salt).integers(1, 1 << 63, len(mask), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.full(n, salt, np.uint64)
    for at, f in zip(mask, factors, strict=True):
        total += words[at : at + n] * f
    return mix(total)


@dataclass
class Items:
    """A slice of the benchmark. seeds: sorted hashes; for each the item's number and the place of its first word.

    run_first, run_item: where the places of one item under one seed begin in seeds, and the item.
    """

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    masks: list[tuple[tuple[int, ...], int]]
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray
    run_first: np.ndarray
    run_item: np.ndarray
    table: np.ndarray


def prepare(ids: list[int], texts: pa.Array) -> Items:
    raw, offsets = text_bytes(texts)
    start, end, first = word_spans(raw, offsets)
    words = word_hashes(raw, start, end)
    used, seeds, item, at = [], [], [], []
    sizes = np.diff(first)
    for window in sorted({min(WINDOW, int(n)) for n in sizes if n}):
        for k, mask in enumerate(masks(window)):
            salt = window * 16 + k
            used.append((mask, salt))
            for i in np.flatnonzero(np.minimum(WINDOW, sizes) == window):
                h = _masked(words[first[i] : first[i + 1]], mask, salt)
                seeds.append(h)
                item.append(np.full(len(h), i))
                at.append(np.arange(len(h)))
    none = np.zeros(0, np.int64)
    h = np.concatenate([np.zeros(0, np.uint64), *seeds])
    numbers = np.concatenate([none, *item])
    order = np.lexsort((numbers, h))
    h, numbers = h[order], numbers[order]
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (numbers[1:] != numbers[:-1])
    run_first = np.flatnonzero(new)
    return Items(np.array(ids, np.int64), words, first, used, h, numbers, np.concatenate([none, *at])[order], run_first, numbers[run_first], table)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], ..., begin[i] + size[i] - 1 for all i, one after the other."""
    return np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _all_diagonals(own: np.ndarray, text: np.ndarray, window: int) -> tuple[int, int, int, int] | None:
    """The best stretch over every diagonal: (words in place, minus its first word in the text, words, windows)."""
    m, t = len(own), len(text)
    filler = np.setdiff1d(np.arange(m + 1, dtype=np.uint64), own)[:1]  # a hash that no word of the item has
    padded = np.concatenate([np.repeat(filler, m), text, np.repeat(filler, m)])
    views = np.lib.stride_tricks.sliding_window_view(padded, m)
    starts = np.arange(m - window + 1)
    best, step, last = None, max(1, (1 << 21) // m), t + m - window + 1
    for lo in range(window, last, step):
        shift = np.arange(lo, min(lo + step, last)) - m  # of the item's first word in the text
        sums = np.zeros((len(shift), m + 1), np.int32)
        np.cumsum(views[shift + m] == own, axis=1, out=sums[:, 1:])
        good = sums[:, window:] - sums[:, :-window] >= needed(window)
        good &= (starts >= -shift[:, None]) & (starts + window <= t - shift[:, None])
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            where = np.flatnonzero(good[i])
            a, b = int(where[0]), int(where[-1]) + window
            found = (int(sums[i, b] - sums[i, a]), -(int(shift[i]) + a), b - a, len(where))
            if best is None or found > best:
                best = found
    return best


def _one_diagonal(own: np.ndarray, text: np.ndarray, shift: int, window: int) -> tuple[int, int, int, int] | None:
    """The same for one shift of the item's first word in the text."""
    a, b = max(0, -shift), min(len(own), len(text) - shift)
    if b - a < window:
        return None
    sums = np.cumsum(np.concatenate([[0], own[a:b] == text[shift + a : shift + b]]))
    good = np.flatnonzero(sums[window:] - sums[:-window] >= needed(window))
    if not len(good):
        return None
    x, y = int(good[0]), int(good[-1]) + window
    return int(sums[y] - sums[x]), -(shift + a + x), y - x, len(good)


def find_block(items: Items, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item number, first word, last word + 1, words in place, windows) for each row and item that overlap.

    Words that repeat in a text and in an item meet often: where a row and an item have
    more hits than they have diagonals, all diagonals are compared and hits are not listed.
    """
    start, end, first = word_spans(raw, offsets)
    words = word_hashes(raw, start, end)
    n_items, n_seeds = max(1, len(items.ids)), max(1, len(items.seeds))
    sizes, lengths = np.diff(items.first), np.diff(first)
    hits = []
    for mask, salt in items.masks:
        h = _masked(words, mask, salt)
        p = np.flatnonzero(items.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        row = np.searchsorted(first, p, "right") - 1
        inside = p + mask[-1] < first[row + 1]
        p, row = p[inside], row[inside]
        lo, hi = np.searchsorted(items.seeds, h[p], "left"), np.searchsorted(items.seeds, h[p], "right")
        some = hi > lo
        hits.append((p[some], row[some], lo[some], hi[some]))
    if not sum(len(h[0]) for h in hits):
        return []
    p, row, lo, hi = (np.concatenate(c) for c in zip(*hits, strict=True))
    run_size = np.diff(items.run_first, append=len(items.seeds))

    # hits of each row and item, from the rows' distinct seeds
    _, place, times = np.unique(row * n_seeds + lo, return_index=True, return_counts=True)
    run_lo, run_hi = np.searchsorted(items.run_first, lo), np.searchsorted(items.run_first, hi)
    n_runs = (run_hi - run_lo)[place]
    runs = _ranges(run_lo[place], n_runs)
    pairs, where = np.unique(np.repeat(row[place], n_runs) * n_items + items.run_item[runs], return_inverse=True)
    load = np.bincount(where, np.repeat(times, n_runs) * run_size[runs], len(pairs))
    heavy = pairs[load > lengths[pairs // n_items] + sizes[pairs % n_items]]

    # of all others each hit, then its diagonal
    n_runs = run_hi - run_lo
    runs, at, own_row = _ranges(run_lo, n_runs), np.repeat(p, n_runs), np.repeat(row, n_runs)
    light = ~np.isin(own_row * n_items + items.run_item[runs], heavy)
    runs, at, own_row = runs[light], at[light], own_row[light]
    which, n_hits = _ranges(items.run_first[runs], run_size[runs]), run_size[runs]
    at, own_row = np.repeat(at, n_hits), np.repeat(own_row, n_hits)
    lines = np.unique(np.column_stack([own_row, items.seed_item[which], at - first[own_row] - items.seed_at[which]]), axis=0)

    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    item = lambda i: items.words[items.first[i] : items.first[i + 1]]
    for r, i in (divmod(x, n_items) for x in heavy.tolist()):
        if found := _all_diagonals(item(i), words[first[r] : first[r + 1]], min(WINDOW, int(sizes[i]))):
            best[r, i] = found
    for r, i, shift in lines.tolist():
        found = _one_diagonal(item(i), words[first[r] : first[r + 1]], shift, min(WINDOW, int(sizes[i])))
        if found and ((r, i) not in best or found > best[r, i]):
            best[r, i] = found
    return [(r, i, -v[1], v[2] - v[1], v[0], v[3]) for (r, i), v in sorted(best.items())]


_SCHEMA = "row_id long, doc_id long, tag long, start_word long, end_word long, n_same long, n_windows long, item_words long"


def _texts(benchmark: DataFrame, item_text: str, item_key: str) -> DataFrame:
    """tag, item_id, text: the benchmark's items; tag names their text."""
    text = benchmark[item_text].cast("string")
    return benchmark.select(F.xxhash64(text).alias("tag"), F.coalesce(benchmark[item_key].cast("long"), F.lit(-1)).alias("item_id"), text.alias("text")).where("text IS NOT NULL")


def _slices(texts: DataFrame) -> Iterator[Items]:
    """The distinct texts of the benchmark in parts of bounded size, one at a time; ids are tags."""
    once = texts.groupBy("tag").agg(F.first("text").alias("text"))
    total = once.agg(F.sum(F.length("text"))).first()[0] or 0
    n_slices = max(1, -(-total // (2 * SLICE_WORDS)))  # a word and its space are two characters at least
    for s in range(n_slices):
        held = once.where(F.pmod(F.xxhash64("tag"), F.lit(n_slices)) == s).orderBy("tag").collect()
        yield prepare([r.tag for r in held], pa.array([r.text for r in held], pa.string()))


def _passes(rows: DataFrame, slices: Iterator[Items], one) -> DataFrame:
    """one(rows or what the last pass made, held slice) for each slice; all but the last pass are written before the next slice is sent out, and their slice is given up."""
    found, held = None, None
    for items in slices:
        if found is not None:
            found = stored(found, "overlaps")
            held.destroy()
        held = rows.sparkSession.sparkContext.broadcast(items)
        found = one(found, held)
    return found


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row for each document and item that overlap, with the best aligned stretch of the document, in words. An item without id is -1."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]

    def one(before: DataFrame | None, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = held.value
            sizes = np.diff(items.first)
            for batch in batches:
                for lo, _, raw, offsets in text_blocks(batch.column(2), BLOCK_BYTES):
                    if found := find_block(items, raw, offsets):
                        row, number, a, b, same, windows = (np.array(c, np.int64) for c in zip(*found, strict=True))
                        take = pa.array(row + lo)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c) for c in (items.ids[number], a, b, same, windows, sizes[number]))], names)

        found = rows.mapInArrow(run, _SCHEMA)
        return found if before is None else before.unionAll(found)

    texts = _texts(benchmark, item_text, item_key)
    found = _passes(rows, _slices(texts), one)
    return found.join(texts.drop("text"), "tag").select(*("item_id" if c == "tag" else c for c in names))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of docs, with all their columns, that overlap no item. Nothing is shuffled."""
    at = docs.columns.index(text)
    schema = docs.schema

    def one(before: DataFrame | None, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, raw, offsets in text_blocks(batch.column(at), BLOCK_BYTES):
                    clean[[lo + f[0] for f in find_block(held.value, raw, offsets)]] = False
                yield batch.filter(pa.array(clean))

        return (docs if before is None else before).mapInArrow(run, schema)

    return _passes(docs, _slices(_texts(benchmark, item_text, item_key)), one)
