"""Near duplicates by bottom-k sketches: inverted lists, union-sketch estimates, exact Jaccard.

A document's set holds the 63-bit fingerprints of its distinct shingles (the one hash
function); its sketch is the smallest SKETCH of them. Equal sets become one node first, so
copies cost nothing from there on.

Candidates. Sketches of two linked nodes share at least t values (exactly so for sets
within SKETCH; for larger ones with a chance of failure of at most MISS, whatever the
threshold), so they share
one of the size - t + 1 rarest. Only these go into the inverted lists; rarity is read from
a table of CELLS counters of all sketch values, so boilerplate comes last. In each list
every member is paired with one hub, the member whose sketch values are the most frequent
(the text that the others vary). The union sketch (smallest SKETCH values of both sketches)
estimates each pair's similarity; pairs that may reach the threshold are verified on full
sets.

The rest, exactly. Members of lists of three or more are also compared with each other, in
blocks of bounded size inside a task: first by the values that their sketches
share, which leaves the members that may have a partner other than the hub; then, in
lists that the hub's links do not join into one label, on full sets. A task returns
members, then a spanning forest of links, never all pairs. So every pair that shares a
list is decided, no list is capped, and no group is collected in one task.

Full sets are made only for nodes that an estimate left, by a second pass over the texts;
a bitmap of fixed size tells them, so it lets some others through but misses none.

Defined cases: null and empty texts have an empty set and no links (kept, their own
component); texts of fewer words than a shingle are one shingle; repeated rows share a
component; a row whose doc_id is null is treated like any other, with a null doc_id
sorting last when the smallest of a component is named and first when one row of it is
kept; texts of any length are read whole, in blocks; an empty table gives an empty one;
columns of any name pass through one_of_each.

No task holds a frequent value, hub or set: rows that name one go to slices of it, or
meet a broadcast of at most HOT_KEYS keys (see functions/tables). Lists of which every
member must be compared with every other are cut into blocks; a list of m members then
takes m * m / BLOCK rows (of sketches) in its block pairs, and m * m comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, free, join_split, release, sliced_join, stored
from .components import connected
from .hashing import combine, mix, text_bytes, word_hashes, word_spans

SKETCH = 64
CELLS = 1 << 21
BITMAP = 1 << 26
SEGMENTS = 64
#: Members of a list that are compared at once, by number and by values of their sets together.
BLOCK, BLOCK_VALUES = 2560, 1 << 20
#: Members of lists that one task of the exact comparison holds, unless a single list has more.
TASK_MEMBERS = 3000
BLOCK_BYTES = 1_500_000
#: Greatest chance that the sketches of two sets over SKETCH values, similar exactly at the threshold, share too few values.
MISS = 1e-6


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row its sorted distinct shingle fingerprints, 63 bits each."""
    start, end, first = word_spans(raw, offsets)
    words = word_hashes(raw, start, end)
    n = len(words) - width + 1
    whole = (combine(*(words[i : i + n] for i in range(width))) >> np.uint64(1)).view(np.int64) if n > 0 else np.zeros(0, np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append((combine(*(words[i : i + 1] for i in range(a, b))) >> np.uint64(1)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _node(values: np.ndarray) -> int:
    """A fingerprint of a whole set, 63 bits."""
    v = values.view(np.uint64)
    with np.errstate(over="ignore"):
        total = mix(v ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + mix(v).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(v))
    return int(mix(np.array([total], np.uint64))[0] >> np.uint64(1))


@cache
def large_share(threshold: float) -> int:
    """The most values t for which a binomial count of SKETCH draws at the threshold is under t with a chance of at most MISS."""
    below, t = 0.0, 0
    while t < SKETCH:
        below += math.comb(SKETCH, t) * threshold**t * (1 - threshold) ** (SKETCH - t)
        if below > MISS:
            break
        t += 1
    return max(1, t)


def shared_at_least(n: int, threshold: float) -> int:
    """Values that the sketch of a set of n shares with the sketch of any similar set."""
    if n > SKETCH:
        return large_share(threshold)
    return max(1, math.ceil(threshold * n - 1e-9) - max(0, int(n / threshold + 1e-9) - SKETCH))


def _slot(node: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return (mix(node.view(np.uint64) ^ mix(doc_id.view(np.uint64))) >> np.uint64(8)).astype(np.int64) % BITMAP


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = text_bytes(batch.column(column))
    block = offsets[1:] // BLOCK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _gathered(rows: DataFrame, fill, size: int, join: np.ufunc) -> np.ndarray:
    """A table of `size` cells that every task fills and that are joined segment by segment; its size is fixed, whatever the rows."""
    part, kind = size // SEGMENTS, np.dtype(np.uint32 if join is np.add else np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, kind)
        for batch in batches:
            if batch.num_rows:
                fill(table, batch)
        for s in range(SEGMENTS):
            x = table[s * part : (s + 1) * part]
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["segment", "data"])

    def merged(group: pa.Table) -> pa.Table:
        total = np.zeros(part, kind)
        for x in group.column("data"):
            join(total, np.frombuffer(x.as_py(), kind), out=total)
        return pa.table({"segment": group.column("segment").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    schema = "segment int, data binary"
    found = rows.mapInArrow(run, schema).groupBy("segment").applyInArrow(merged, schema).toArrow()
    out = np.zeros(size, kind)
    for s, x in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[s * part : (s + 1) * part] = np.frombuffer(x, kind)
    return out


def _cell(values: np.ndarray) -> np.ndarray:
    return mix(values.view(np.uint64)).astype(np.int64) & (CELLS - 1)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def sketches(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, h (a hash of the text), n (size of the set), node, sketch; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in _blocks(batch, 1):
                sets = shingle_sets(raw, offsets, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), _lists([s[:SKETCH] for s in sets])],
                    ["doc_id", "h", "n", "node", "sketch"],
                )

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), F.xxhash64(docs[text]).alias("h"))
    return stored(rows.mapInArrow(run, "doc_id long, h long, n long, node long, sketch array<long>"), "sketches")


def _entries(nodes: DataFrame, threshold: float) -> DataFrame:
    """value, node, n, score: for each node the rarest values of its sketch."""

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        table += np.bincount(_cell(_flat(batch.column(0))), minlength=CELLS).astype(np.uint32)

    held = nodes.sparkSession.sparkContext.broadcast(_gathered(nodes.select("sketch"), fill, CELLS, np.add))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for batch in batches:
            values, owners, scores, sizes = [], [], [], []
            flat, node, n = _flat(batch.column(2)), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.cumsum([len(x) for x in batch.column(2)])
            count = cells[_cell(flat)]
            for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                c, v = count[a:b], flat[a:b]
                rare = np.lexsort((v, c))[: len(v) - shared_at_least(int(n[i]), threshold) + 1]
                values.append(v[rare])
                owners.append(np.full(len(rare), node[i]))
                sizes.append(np.full(len(rare), n[i]))
                scores.append(np.full(len(rare), float(np.log(c).mean())))
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (values, owners, sizes, scores)], ["value", "node", "n", "score"])

    return nodes.select("node", "n", "sketch").mapInArrow(run, "value long, node long, n long, score double")


def _full_sets(docs: DataFrame, members: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """node, shingles for the nodes of members (node, rep); written once."""

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        at = _slot(batch.column(0).to_numpy(), batch.column(1).fill_null(-1).to_numpy())
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))

    held = docs.sparkSession.sparkContext.broadcast(_gathered(members.select("node", "rep"), fill, BITMAP // 8, np.bitwise_or))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            for lo, hi, raw, offsets in _blocks(batch, 1):
                sets = shingle_sets(raw, offsets, width)
                node = np.array([_node(s) if len(s) else -1 for s in sets], np.int64)
                at = _slot(node, batch.column(0).slice(lo, hi - lo).fill_null(-1).to_numpy())
                wanted = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & (node >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(node[wanted]), _lists([sets[i] for i in wanted])], ["node", "shingles"])

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    # rows that repeat in full give a set twice, and the bitmap lets some others through: neither changes a result
    out = stored(rows.mapInArrow(run, "node long, shingles array<long>"), "sets")
    held.destroy()
    return out


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of a with sets of b: frequent values by a product of matrices, the others one by one."""
    out = np.zeros((len(a), len(b)), np.float32)
    va, vb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), list(map(len, a))), np.repeat(np.arange(len(b)), list(map(len, b)))
    distinct = np.intersect1d(va, vb)
    if not len(distinct):
        return out

    def placed(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(distinct, v)
        at[at == len(distinct)] = 0
        keep = distinct[at] == v
        return at[keep], r[keep]

    ca, ra = placed(va, ra)
    cb, rb = placed(vb, rb)
    na, nb = np.bincount(ca, minlength=len(distinct)), np.bincount(cb, minlength=len(distinct))
    often = na * nb > 64
    rank = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), 2048):
        x, y = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
        for m, c, r in ((x, ca, ra), (y, cb, rb)):
            k = often[c] & (rank[c] >= lo) & (rank[c] < lo + 2048)
            m[r[k], rank[c[k]] - lo] = 1
        out += x @ y.T
    ka, kb = ~often[ca], ~often[cb]
    ca, ra, cb, rb = ca[ka], ra[ka], cb[kb], rb[kb]
    order = np.argsort(cb, kind="stable")
    cb, rb = cb[order], rb[order]
    begin, end = np.searchsorted(cb, ca, "left"), np.searchsorted(cb, ca, "right")
    n = end - begin
    if n.sum():
        left = np.repeat(ra, n)
        right = rb[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        np.add.at(out, (left, right), 1)
    return out


def _forest(nodes_a: np.ndarray, sets_a: list[np.ndarray], labels_a: np.ndarray, nodes_b: np.ndarray, sets_b: list[np.ndarray], labels_b: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between nodes of different labels, without those that close a circle."""
    both = _overlaps(sets_a, sets_b)
    na, nb = np.array(list(map(len, sets_a)), np.float32), np.array(list(map(len, sets_b)), np.float32)
    linked = (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (labels_a[:, None] != labels_b[None, :])
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(linked).tolist():
        x, y = top(int(labels_a[i])), top(int(labels_b[j]))
        if x != y:
            parent[x] = y
            out.append((int(nodes_a[i]), int(nodes_b[j])))
    return out


def _unlike(members: DataFrame) -> DataFrame:
    """members without lists that have the same members as another list: comparing them again tells nothing new."""
    whole = members.groupBy("value").agg(F.count(F.lit(1)).alias("n_members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    chosen = stored(whole.groupBy("n_members", "x", "y").agg(F.min("value").alias("value")).select("value", "n_members"), "unlike", merged=True)
    total = chosen.agg(F.sum("n_members")).first()[0] or 0
    return join_split(members, chosen, "value", "n_members", total).drop("n_members")


def _dealt(members: DataFrame) -> DataFrame:
    """members (value, node, size and weight of the list, ...): lists cut into blocks, one row for each block that its block meets, and the task that gets it."""
    n_tasks = max(1, -(-members.count() // TASK_MEMBERS))
    cut = members.withColumn("blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / BLOCK_VALUES)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    task = F.when(F.col("blocks") > 1, F.xxhash64("value", "i", "j")).otherwise(F.pmod(F.xxhash64("value"), F.lit(n_tasks)))
    # far more rows than Spark expects of them, so never broadcast
    return met.withColumn("task", task).drop("blocks", "other", "size", "weight").hint("merge")


def _per_list(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each (list, block, block) of a task: those of the first block and those of the second."""
    value, i, j, own, node = (group.column(c).to_numpy() for c in ("value", "i", "j", "own", "node"))
    order = np.lexsort((node, own, j, i, value))
    keys = np.column_stack([value, i, j])[order]
    new = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    for rows in np.split(order, new) if len(order) else []:
        a, b = rows[own[rows] == i[rows]], rows[own[rows] == j[rows]]
        if len(a) and len(b):
            yield a, b


def _cells_of(group: pa.Table, column: str) -> list[np.ndarray]:
    held = group.column(column).combine_chunks()
    values, at = held.values.to_numpy(zero_copy_only=False), held.offsets.to_numpy()
    return [values[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def _active(inverted: DataFrame, short: DataFrame, threshold: float) -> DataFrame:
    """value, node, n: members of lists of three or more whose sketch may reach that of another member, the hub aside."""
    least = {n: shared_at_least(n, threshold) for n in range(1, SKETCH + 2)}

    def compare(group: pa.Table) -> pa.Table:
        node, hub, n, value = (group.column(c).to_numpy() for c in ("node", "hub", "n", "value"))
        sketch = _cells_of(group, "sketch")
        need = np.array([least[min(int(x), SKETCH + 1)] for x in n], np.float32)
        out: set[tuple[int, int]] = set()
        for a, b in _per_list(group):
            shared = _overlaps([sketch[k] for k in a], [sketch[k] for k in b])
            likely = shared >= np.minimum(need[a][:, None], need[b][None, :])
            likely &= (node[a][:, None] != node[b][None, :]) & (node[a] != hub[a])[:, None] & (node[b] != hub[b])[None, :]
            likely &= np.minimum(n[a][:, None], n[b][None, :]) >= threshold * np.maximum(n[a][:, None], n[b][None, :])
            out.update((int(value[k]), int(node[k])) for k in np.concatenate([a[likely.any(axis=1)], b[likely.any(axis=0)]]))
        x = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pa.table({"value": x[:, 0], "node": x[:, 1]})

    members = inverted.where("members > 2").select("value", "node", "hub", F.col("members").alias("size"), (F.col("members") * SKETCH).alias("weight"))
    tasks = _dealt(stored(_unlike(members), "members", merged=True)).join(short, "node")
    found = tasks.groupBy("task").applyInArrow(compare, "value long, node long").distinct()
    return found.join(inverted.select("value", "node", "n"), ["value", "node"])


def links(docs: DataFrame, nodes: DataFrame, width: int, percent: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """a, b: links between nodes that join exactly the nodes which similar pairs join. nodes: node, rep, n, sketch."""
    threshold = percent / 100
    entries = _entries(nodes, threshold)
    by_value = entries.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("score", "node", "n")).alias("best")).where("members > 1")
    values = stored(by_value.select("value", "members", F.col("best.node").alias("hub"), F.col("best.n").alias("hub_n")), "values", merged=True)
    of_value = values.select("value", F.col("members").alias("n"))
    total = values.agg(F.sum("members")).first()[0] or 0
    inverted = stored(sliced_join(entries.drop("score"), values, "value", of_value, total, "node").select("value", "node", "n", "members", "hub", "hub_n"), "lists", merged=True)
    discard(values)
    release(docs.sparkSession)

    # every member with its list's hub: estimates from union sketches
    short = nodes.select("node", "n", "sketch")
    pairs = inverted.where(f"node <> hub AND 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select("node", "hub").distinct()
    # both sides are plain shuffles of one table of sketches, so it is dealt out once, and Spark splits a frequent hub's part
    met = pairs.join(short, "node").join(short.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch")), "hub")
    both = F.array_union("sketch", "hub_sketch")
    union = F.slice(F.array_sort(both), 1, SKETCH)
    common = F.array_intersect("sketch", "hub_sketch")
    whole = (F.col("n") <= SKETCH) & (F.col("hub_n") <= SKETCH)  # then sketches are the sets
    may = F.when(whole, 100 * F.size(common) >= percent * F.size(both)).otherwise(F.size(F.array_intersect(union, common)) >= large_share(threshold))
    likely = stored(met.where(may).select("node", "hub", "n", "hub_n"), "likely", merged=True)

    active = stored(_active(inverted, short, threshold), "active", merged=True)
    wanted = likely.select("node").unionAll(likely.select("hub")).unionAll(active.select("node")).distinct()
    sets = _full_sets(docs, nodes.select("node", "rep").join(wanted, "node", "left_semi"), width, text, key)

    full = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles"))
    of_hub = likely.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    exact = sliced_join(likely.join(sets, "node"), full, "hub", of_hub, likely.count(), "node").withColumn("both", F.size(F.array_intersect("shingles", "hub_shingles")))
    starred = stored(exact.where(100 * F.col("both") >= percent * (F.col("n") + F.col("hub_n") - F.col("both"))).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "links", merged=True)

    release(docs.sparkSession)
    # one step along the stars: enough to see that a list is joined, never wrong
    label = starred.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
    labelled = stored(active.join(label, "node", "left").select("value", "node", "n", F.coalesce("to", "node").alias("label")), "labels", merged=True)
    open_lists = labelled.groupBy("value").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("least < most")
    left = stored(join_split(labelled.drop("n"), open_lists.drop("least", "most"), "value", "size", labelled.count()), "open-lists", merged=True)
    tasks = _dealt(stored(_unlike(left), "members", merged=True)).join(sets, "node")

    def compare(group: pa.Table) -> pa.Table:
        node, own_label = group.column("node").to_numpy(), group.column("label").to_numpy()
        held = _cells_of(group, "shingles")
        out: set[tuple[int, int]] = set()
        for a, b in _per_list(group):
            out.update(_forest(node[a], [held[k] for k in a], own_label[a], node[b], [held[k] for k in b], own_label[b], percent))
        x = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pa.table({"a": x[:, 0], "b": x[:, 1]})

    return starred.unionAll(tasks.groupBy("task").applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept, group_id for each row of docs.

    width: words of a shingle. percent: least similarity in percent. group_id names the
    component also where doc_id does not (it is null for rows without words); h is a hash of the text.
    """
    sketched = sketches(docs, width, text, key)
    rows = stored(sketched.select("doc_id", "h", "n", "node"), "rows", merged=True)
    by_set = sketched.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(by_set, "nodes", merged=True)
    discard(sketched)
    roots = connected(links(docs, nodes, width, percent, text, key))
    rooted = stored(nodes.join(roots, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("group_id")), "groups", merged=True)
    first = rooted.groupBy("group_id").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = join_split(rooted, first, "group_id", "size", rooted.count()).select("node", "copies", "group_id", "component_id")
    # rows of one set are as many as its copies: those of frequent sets are named where they are
    some = join_split(rows.where("n > 0"), named, "node", "copies", rows.count()).select("doc_id", "h", "n", "component_id", "group_id")
    out = some.unionByName(rows.where("n = 0").select("doc_id", "h", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group_id")))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "group_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, without near duplicates: of each component the row with the smallest doc_id stays, and rows without words stay.

    Rows that agree in doc_id and text are one document (which of them stays, if other
    columns differ, is not defined), unless they have no words. Only such rows are grouped.
    """
    doc, hashed, copies, own_hash, own_key = free(docs, "near_doc", "near_hash", "near_copies", "near_own_hash", "near_own_key")
    found = stored(near_duplicates(docs, width, percent, text, key).select("doc_id", "h", "group_id"), "near", merged=True)
    some = found.where("group_id IS NOT NULL")
    first = some.groupBy("group_id").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("first.doc_id", "first.h")
    n_rows = some.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    keep = first.join(n_rows, first["doc_id"].eqNullSafe(n_rows["doc_id"]) & (first["h"] == n_rows["h"])).select(first["doc_id"].alias(doc), first["h"].alias(hashed), F.col("n").alias(copies))
    keep = stored(keep, "keep", merged=True)
    own = docs.withColumn(own_hash, F.xxhash64(docs[text])).withColumn(own_key, docs[key].cast("long"))
    same = F.col(own_key).eqNullSafe(F.col(doc)) & (F.col(own_hash) == F.col(hashed))
    words = F.coalesce(own[text], F.lit("")).rlike(WORD)
    alone = own.where(words).join(keep.where(F.col(copies) == 1), same, "left_semi")
    repeated = own.where(words).join(keep.where(F.col(copies) > 1), same, "left_semi").dropDuplicates([own_key, own_hash])
    return own.where(~words).unionByName(alone).unionByName(repeated).drop(own_hash, own_key)
