"""Duplicates, neighbours, overlaps with a benchmark, mixing and the pipeline against plain versions."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import components, decontamination, line_dedup, mixing, near_duplicates, nearest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts, source=None):
    return spark.createDataFrame([(i, t, None, source, None) for i, t in enumerate(texts)], DOCS)


class Union(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)


def _plain_groups(texts, width, percent):
    sets = []
    for t in texts:
        w = bytes(t or "", "utf8").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    u = Union()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                u.join(i, j)
    return [u.top(i) for i in range(len(texts))], [len(s) for s in sets]


def _varied(seed, n, size, change):
    r = random.Random(seed)
    bases = [[f"w{r.randint(0, 400)}" for _ in range(r.randint(1, size))] for _ in range(6)]
    out = [None, "", "  ", "One two", "one TWO"]
    for _ in range(n):
        words = list(r.choice(bases))
        for i in range(len(words)):
            if r.random() < change:
                words[i] = f"x{r.randint(0, 10_000)}"
        out.append(" ".join(words))
    return out + out[6:12]


@pytest.mark.parametrize(("seed", "size", "change", "block"), [(1, 30, 0.01, 2560), (2, 200, 0.01, 2560), (3, 120, 0.02, 4), (4, 8, 0.05, 3)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, seed, size, change, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    texts = _varied(seed, 150, size, change)
    groups, sizes = _plain_groups(texts, 3, 85)
    got = near_duplicates.near_duplicates(_docs(spark, texts), 3, 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == {i: (sizes[i], g, g == i) for i, g in enumerate(groups)}


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_large_sets_miss_rarely_at_any_threshold(percent):
    n, t = near_duplicates.SKETCH, near_duplicates.shared_at_least(1000, percent / 100)
    chance = lambda t: sum(math.comb(n, k) * percent**k * (100 - percent) ** (n - k) for k in range(t)) / 100**n
    assert chance(t) <= 1e-6 < chance(t + 1)


def test_one_of_each_keeps_columns_and_rows(spark):
    docs = _docs(spark, ["a b c d e f", "a b c d e f", "other words of their own here", "", None]).withColumn("node", F.lit(7)).withColumn("n", F.lit("x"))
    docs = docs.unionAll(docs.where("doc_id = 2"))
    out = near_duplicates.one_of_each(docs)
    assert out.columns == docs.columns and sorted(x.doc_id for x in out.collect()) == [0, 2, 3, 4]
    assert near_duplicates.one_of_each(docs.limit(0)).count() == 0


def test_overlaps_of_sets():
    r = np.random.default_rng(1)
    a = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(30)]
    b = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(20)]
    assert (near_duplicates._overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(500 + r.randint(0, 30), 500 + r.randint(0, 30)) for _ in range(20)] + [(7, 7)]
    u = Union()
    for a, b in pairs:
        u.join(a, b)
    got = {x.node: x.root for x in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: u.top(n) for n in {x for p in pairs if p[0] != p[1] for x in p}}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_line_dedup_equals_all_pairs(spark, edits):
    r = random.Random(edits)
    base = ["".join(r.choice("abé𝄞 ") for _ in range(r.randint(8, 30))).strip(" ") for _ in range(12)]

    def worn(s):
        s = list(s)
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            k = r.randint(0, len(s))
            s[k : k + r.choice([0, 1])] = r.choice(["", "a", "z"])
        return "".join(s)

    texts = [None, "", "\n\n", "short\nshort"] + ["\n".join([worn(r.choice(base)) for _ in range(r.randint(1, 6))] + ["end"]) for _ in range(60)]
    lines = {}
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if len(line.strip(" ")) >= 8:
                lines.setdefault(line.strip(" "), []).append((i, n))
    u = Union()
    for a in lines:
        for b in lines:
            if a < b and _distance(a, b) <= edits:
                u.join(a, b)
    classes = {}
    for line, places in lines.items():
        classes.setdefault(u.top(line), []).extend(places)
    gone = {p for places in classes.values() for p in sorted(places)[1:]}
    want = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in enumerate(texts)}
    docs = _docs(spark, texts).withColumn("removed", F.lit(1)).withColumn("h", F.lit(2))
    docs = docs.withColumn("_lines", F.lit(3)).withColumn("line_hash", F.lit(4)).withColumn("__slices", F.lit(5))
    out = line_dedup.dedup_lines(docs, edits, min_chars=8)
    assert out.columns == docs.columns
    assert {x.doc_id: x.text for x in out.collect()} == want
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_short_lines_go_as_exact_copies_only(spark, tmp_path):
    from maskwright.llm import queries

    texts = ["menu\na line that is long enough to be linked\n\n\t", "a line that is long enough to be linkt\nmenu\n\n\t", "menus\n menu \nother"]
    docs = _docs(spark, texts)
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs, copy_chars=line_dedup.COPY_CHARS).collect()}
    assert got == {0: texts[0], 1: "\n\t", 2: "menus\nother"}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((x.doc_id, x.n_lines, x.n_kept) for x in queries.op2_line_dedup(spark, str(tmp_path)).collect()) == [(0, 4, 4), (1, 4, 2), (2, 3, 2)]


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_banded_bits_equal_the_distance(spark, edits):
    r = random.Random(edits)
    pairs = [("", ""), ("", "ab"), ("a", "a"), ("ab", "ba"), ("𝄞é", "é𝄞x"), ("a" * 70, "a" * 72), ("ab" * 40, "ba" * 40)]
    for _ in range(300):
        a = "".join(r.choice("abé𝄞") for _ in range(r.randint(0, 70)))
        b = list(a)
        for _ in range(r.randint(0, 6)):
            k = r.randint(0, len(b))
            b[k : k + r.choice([0, 1])] = r.choice(["", "a", "z"])
        pairs.append(tuple(sorted((a, "".join(b)), key=len)))
    rows = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = rows.select("a", "b", line_dedup.within_edits(a, b, edits).alias("near"), line_dedup.linked(a, b, edits).alias("linked"), line_dedup.segments_held(a, b, edits).alias("held")).collect()
    for x in got:
        near = _distance(x.a, x.b) <= edits
        assert (x.near, x.linked) == (near, near) and (x.held or not near), (x.a, x.b)


@pytest.mark.parametrize("hot", [2, 10_000])
def test_a_line_in_most_documents_is_split(spark, monkeypatch, hot):
    from maskwright.functions import tables

    monkeypatch.setattr(tables, "HOT_KEYS", hot)
    monkeypatch.setattr(tables, "SPLIT_FROM", 0)
    common = "a line that stands in nearly all of the documents"
    texts = [f"{common if i % 3 else common[:-1]}\nline {i} of its own, quite long" for i in range(120)]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(_docs(spark, texts)).collect()}
    u, lines = Union(), {}
    for i, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            lines.setdefault(line, []).append((i, n))
    for a in lines:
        for b in lines:
            if a < b and _distance(a, b) <= 2:
                u.join(a, b)
    classes = {}
    for line, at in lines.items():
        classes.setdefault(u.top(line), []).extend(at)
    gone = {p for at in classes.values() for p in sorted(at)[1:]}
    assert got == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in enumerate(texts)}


def test_line_links_by_shuffle_are_the_same(spark, monkeypatch):
    lines = spark.createDataFrame([("the quick brown fox",), ("the quick brown fix",), ("a quick brown fox is",), ("something else here",)], "line string")
    few = sorted(map(tuple, line_dedup.line_links(lines).collect()))
    monkeypatch.setattr(line_dedup, "FEW_KEYS", 0)
    assert len(few) == 1 and sorted(map(tuple, line_dedup.line_links(lines).collect())) == few


def test_only_rows_of_live_keys_are_shuffled(spark):
    """A bitmap keeps all rows of live keys, negative and large ones too, and nearly none of the others."""
    rows = spark.range(100_000).select(F.xxhash64("id").alias("key"), F.col("id").alias("line"))
    live = rows.where("line % 50 = 0").select("key").unionAll(spark.createDataFrame([(0,), (-1,), (-(1 << 63),), ((1 << 63) - 1,)], "key long"))
    rows = rows.unionAll(spark.createDataFrame([(0, -1), (-1, -1), (-(1 << 63), -1), ((1 << 63) - 1, -1)], "key long, line long"))
    kept = line_dedup._likely(rows, live, 2_004)
    assert kept.columns == rows.columns
    lines = [r.line for r in kept.collect()]
    assert lines.count(-1) == 4 and sum(x >= 0 and x % 50 == 0 for x in lines) == 2_000 and len(lines) < 4_500
    exact = line_dedup._of_many(rows, live, 2_004)
    joins = [x for x in exact._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 2 and "part" not in joins[0] and "part" in joins[1]  # the bitmap comes first, below the join that shuffles
    assert sorted(r.line for r in exact.collect()) == sorted([-1] * 4 + list(range(0, 100_000, 50)))


def _plain_near(vectors, every, k):
    out = {}
    for i, q in vectors.items():
        if i % every == 0:
            out[i] = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), j) for j, v in vectors.items() if j != i)[:k]
    return out


def test_neighbours_of_few_vectors_are_exact(spark):
    r = np.random.default_rng(2)
    vectors = {i: r.normal(size=6).tolist() for i in range(60)}
    vectors |= {i: vectors[0] for i in range(60, 75)}
    bad = [(100, None), (102, [0.0] * 6), (104, [float("nan")] * 6), (106, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (108, [1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in [*vectors.items(), *bad]], "vec_id long, embedding array<float>, score int")
    exact = {i: np.array(v, np.float32).astype(float).tolist() for i, v in vectors.items()}
    got = {}
    for x in nearest.neighbours(table, 20, 10).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.score, x.vec_id))
    want = _plain_near(exact, 20, 10)
    assert got.keys() == want.keys()
    for i in want:
        found = sorted(got[i])
        assert [v for _, _, v in found] == [v for _, v in want[i]] and [s for _, s, _ in found] == pytest.approx([s for s, _ in want[i]])


def test_recall_with_leaves(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 64 * 64)
    monkeypatch.setattr(nearest, "LEAF_VECTORS", 64)
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 8)) * 3
    vectors = {i: (centres[i % 20] + r.normal(size=8)).tolist() for i in range(3000)}
    table = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    index = nearest.build_index(table)
    assert index.tree.n_leaves > 8 and index.tree.visits < index.tree.n_leaves
    got = {}
    for x in nearest.neighbours(table, 50, 10).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    want = _plain_near(vectors, 50, 10)
    assert sum(len(got[i] & {v for _, v in w}) for i, w in want.items()) / (10 * len(want)) > 0.9
    assert nearest.neighbours(table.limit(0), 50).count() == 0


def test_neighbours_of_very_large_and_small_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 3e190]), (2, [-1e200, 0.0]), (3, [1e-200, 1e-200]), (4, [4e-200, 5e-200]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (20, [1e300, 1e300]), (20, [1.0, 1.0])]
    got = {}
    for x in nearest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 3).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert [(v, s) for _, v, s in sorted(got[0])] == [(1, 3e190), (3, 1e200), (4, 1e200)]  # ties to the smaller vec_id
    assert [(v, s) for _, v, s in sorted(got[20])] == [(5, 1.0), (6, 1.0), (3, pytest.approx(math.sqrt(2)))]  # the smaller of its vectors asks
    assert nearest._distances(np.array([[4e-200, 5e-200]]), np.array([1e-200, 2e-200]))[0] == pytest.approx(math.sqrt(18) * 1e-200)


def test_leaves_grow_with_the_table_and_queries_go_on(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 4))
    assert nearest.fit_tree(x, 10, 2_000).n_leaves < nearest.fit_tree(x, 10, 20_000).n_leaves < nearest.fit_tree(x, 10, 10**9).n_leaves
    tree = nearest.fit_tree(x, 10, 10**9)
    counts = np.ones(tree.n_leaves, np.int64)
    assert len(tree.best_bins(tree.scaled(x[:1])[0], 1, counts, 11)) == 11
    near = tree.best_bins(tree.scaled(x[:1])[0], tree.n_leaves)
    assert sorted(near) == list(range(tree.n_leaves))


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_with_a_benchmark(spark, monkeypatch, seed):
    monkeypatch.setattr(decontamination, "SLICE_WORDS", 1000 if seed % 2 else 30)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(r.choice([4, 30]))]
    items = [None, ""] + [" ".join(r.choice(words) for _ in range(r.choice([1, 4, 6, 9, 12, 13, 20, 30]))) for _ in range(6)]
    texts = [None, ""]
    for _ in range(50):
        text = [r.choice(words) for _ in range(r.randint(0, 40))]
        own = (r.choice(items) or "").split()
        k = r.randint(0, len(text))
        text[k:k] = [r.choice(words) if r.random() < 0.15 else w for w in own[r.randint(0, 3) :]]
        texts.append(" ".join(text))
    want = set()
    for i, t in enumerate(texts):
        d = (t or "").split()
        for j, item in enumerate(items):
            w = (item or "").split()
            n = min(13, len(w))
            need = -(-8 * n // 10)
            if n and any(sum(map(str.__eq__, w[q : q + n], d[p : p + n])) >= need for q in range(len(w) - n + 1) for p in range(len(d) - n + 1)):
                want.add((i, j))
    docs = _docs(spark, texts)
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.find_overlaps(docs, table).collect()} == want
    clean = {x.doc_id for x in decontamination.drop_contaminated(docs, table).collect()}
    assert clean == set(range(len(texts))) - {i for i, _ in want}


def _best_stretch(own, text, window, need):
    """Plain version: every diagonal, every window."""
    best = None
    for shift in range(-(len(own) - window), len(text) - window + 1):
        good = [i for i in range(len(own) - window + 1) if 0 <= shift + i and shift + i + window <= len(text) and sum(own[i + k] == text[shift + i + k] for k in range(window)) >= need]
        if good:
            a, b = good[0], good[-1] + window
            same = sum(own[k] == text[shift + k] for k in range(a, b))
            found = (same, -(shift + a), b - a, len(good))
            best = found if best is None or found > best else best
    return best


@pytest.mark.parametrize("alphabet", [2, 5, 60])
def test_overlaps_stand_where_a_plain_search_finds_them(spark, monkeypatch, alphabet):
    monkeypatch.setattr(decontamination, "SLICE_WORDS", 150)
    r = random.Random(alphabet)
    words = lambda n: [f"w{r.randrange(alphabet)}" for _ in range(n)]
    items = [words(r.choice([3, 13, 14, 30, 60])) for _ in range(12)]
    items += [items[0], items[3]]
    texts = []
    for _ in range(25):
        part = list(r.choice(items))
        for k in range(len(part)):
            if r.random() < 0.08:
                part[k] = f"x{k}"
        texts.append(words(r.randint(0, 20)) + part[r.randint(0, 3) :] + words(r.randint(0, 20)))
    docs = _docs(spark, [" ".join(t) for t in texts] + [None, ""])
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(None, None), (99, "")], "item_id long, text string")
    got = sorted((x.doc_id, x.item_id, x.n_same, -x.start_word, x.end_word - x.start_word, x.n_windows) for x in decontamination.find_overlaps(docs, bench).collect())
    want = []
    for d, t in enumerate(texts):
        for i, own in enumerate(items):
            window = min(13, len(own))
            best = _best_stretch(own, t, window, decontamination.needed(window)) if len(t) >= window else None
            if best:
                want.append((d, i, *best))
    assert got == sorted(want)
    clean = {x.doc_id for x in decontamination.drop_contaminated(docs, bench).collect()}
    assert clean == set(range(27)) - {d for d, *_ in want}


def test_words_that_repeat_take_bounded_time():
    items = decontamination.prepare([1, 2], pa.array(["a " * 500, "b c " * 100]))
    raw, offsets = np.frombuffer(b"a " * 40_000 + b"b c " * 5_000, np.uint8), np.array([0, 80_000, 100_000])
    assert decontamination.find_block(items, raw, offsets) == [(0, 0, 0, 500, 500, 488), (1, 1, 0, 200, 200, 188)]


def test_masks_cover_all_substitutions():
    import itertools

    for window in range(1, 14):
        lost = window - decontamination.needed(window)
        for gone in itertools.combinations(range(window), lost):
            assert any(not any(x + o in gone for x in m) for m in decontamination.masks(window) for o in range(window - m[-1]))


def test_mix_takes_its_targets(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(r.randint(0, 90))) if i % 17 else None, s, None) for i in range(400) for s in [r.choice(["a", "b", "c", "d", None, "é"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank string")
    docs = docs.unionAll(docs.where("doc_id in (1, 2)"))
    sized = mixing.sizes(docs)
    mix = mixing.mix(sized, mixing.targets(sized), block_words=16, shard_words=500)
    out = mix.documents.collect()
    assert len(out) == 402 and sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(sized.repartition(3), mixing.targets(sized), 16, 500).documents.collect()))
    by = {}
    for x in out:
        assert 0 <= x.taken <= 2 * x.size
        s = by.setdefault(x.source, [0, 0, x.source_size, x.target])
        s[0] += x.size
        s[1] += x.taken
    total = sum(s[0] for s in by.values())
    assert all(s[0] == s[2] and s[1] == int(s[3]) for s in by.values())
    assert sum(s[3] for s in by.values()) == pytest.approx(1.5 * total)
    order = sorted([s for s in by if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free = {s for s in by if by[s][3] < 2 * by[s][2]}
    levels = {round(by[s][3] / weight[s], 6) for s in free}
    assert len(levels) == 1 and all(2 * by[s][2] <= weight[s] * max(levels) + 1e-6 for s in by if s not in free)
    slots = mix.slots.collect()
    assert len({(x.rank, x.slot) for x in slots}) == len(slots) and len({x.shard for x in slots}) > 5
    in_shard, begins = collections.Counter((x.rank, x.shard) for x in slots), {}
    assert {(x.rank, x.shard): x.n for x in mix.counts.collect()} == in_shard
    for x in sorted(slots, key=lambda x: (x.rank, x.slot)):  # a source's shards stand one after the other
        assert x.shard >= begins.get(x.rank, -1)
        begins[x.rank] = x.shard
    n = [in_shard[rank, shard] for rank, shard in in_shard]
    assert max(n) > min(n)  # drawn, not dealt out evenly


def test_slots_come_from_the_drawn_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(50)], "doc_id long, text string, source string")
    draw = mixing.draw_counts
    monkeypatch.setattr(mixing, "draw_counts", lambda *a: draw(*a).where("shard < 0"))
    assert {x.taken for x in mixing.mix_documents(docs).documents.collect()} == {0}


def test_mix_of_many_buckets_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 90, "a b c d e " * (i % 7), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    totals = lambda rows: sorted((x.source_size, x.target, x.size) for x in rows)
    few = mixing.mix_documents(docs).documents.collect()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    monkeypatch.setattr(mixing, "BUCKETS", 2)
    many = mixing.mix_documents(docs).documents.collect()
    assert totals(few) == totals(many) and sum(x.taken for x in few) == sum(x.taken for x in many)


def test_mix_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(x.size, x.target, x.taken) for x in mixing.mix_documents(docs).documents.collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix_documents(docs.limit(0)).documents.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation(spark, n):
    at = spark.range(n).selectExpr(f"{mixing.permuted('id', f'{n}L', '3L', '1L')} AS p")
    assert sorted(x.p for x in at.collect()) == list(range(n))


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(11)
    plain = [f"word{i}" for i in range(500)]
    said = lambda n: " ".join(r.choice(plain) for _ in range(n))
    shared, item = said(12), said(30)
    rows, labels = [], []
    for i in range(400):
        text = said(60)
        if i < 90:
            text += f" scumbag{r.choice(['', 's'])} idiotic"
        elif i == 100:
            text = base = f"{said(50)}\n{said(40)}"
        elif i == 101:
            text = base.replace("word", "word", 1) + " more"
        elif i in (110, 111, 112):
            text = f"{text}\n{shared}"
        elif i == 120:
            text = f"{text} {item} {said(5)}"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i < 90)))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {x.doc_id: x for x in docs.collect()}
    assert len(set(range(90)) & seen["toxicity"].keys()) <= 9 and len(seen["toxicity"].keys() - set(range(90))) >= 300
    lines = seen["line_dedup"]
    assert shared in lines[110].text and shared not in lines[111].text and lines[111].n_chars == len(lines[111].text)
    assert 120 in seen["near_duplicates"] and 120 not in seen["decontamination"]
    mixed = pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in mixed} == seen["decontamination"].keys() and sum(x.taken for x in mixed) > 0
