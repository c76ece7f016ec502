"""Removes lines that repeat, exactly or within EDITS edits, anywhere in a corpus. DataFrame functions only.

A line is what stands between line breaks, without spaces around it. Lines of MIN_CHARS
characters or more are linked when their Levenshtein distance (in
code points) is at most EDITS; of each connected class the first line stays (smallest
doc_id, then line number) and all others are taken out of their texts. Shorter lines
form classes of exact copies only, from COPY_CHARS characters on (in the queries: all but
blank lines).

Segment-partition join: a line of n characters has EDITS + 1 segments; a line within
EDITS edits of it holds one of them unchanged, at a place that the two lengths bound. Each
line gives its own segments as index keys and, for each length from its own down to EDITS
less, the substrings it must probe (EDITS = 2: 3 and 9 keys). Keys are 64-bit hashes of
length, segment number and substring.

Keys with two different lines are found by one aggregation (minimum and maximum of the
line's hash, so copies and frequent keys combine before the shuffle). Only their lines
meet in a join. There each line is first verified against one hub of its key; lines that
are not joined that way are verified against each other, inside the join condition, so
that only linked pairs come out of it.

Verification is a banded bit-parallel edit distance (within_edits): for each number of
errors one bit for each of the 2 * EDITS + 1 diagonals, all in one long, moved on by a
few bit operations for each character. Before, a line is cut into PROBES * EDITS finer
segments, of which the other one must hold all but EDITS; pairs whose first or last END
characters are further apart than 2 * EDITS go; and what both lines begin and end with is
left out, by segments.

No key is held in one task: hubs of frequent keys go to slices of their lines, lines of
open keys are cut into slices of SLICE, and what is to be taken out is joined to the
places of frequent lines by a broadcast of at most HOT_KEYS rows. Live keys are broadcast
if there are at most FEW_KEYS of them; else a bitmap of them is, and only rows that pass it
(with their lines) are joined by a shuffle.

Defined cases: null and empty texts have no lines and stay as they are; an empty table
gives an empty one; rows that agree in doc_id and text are treated alike (both keep a line
that is first in them); a null doc_id is a doc_id and sorts first; lines of any length are
compared whole; other columns pass through, whatever they are called; a text whose lines
all go becomes empty.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free, join_split, release, sliced_join, stored
from .components import connected

EDITS = 2
MIN_CHARS = 20
#: Exact copies of shorter lines are removed from this length on, where the caller asks for it.
COPY_CHARS = 1
FEW_KEYS = 250_000
#: Of more keys a bitmap is broadcast: so many bits a key, 2**MOST_BITS (64 MB) at most; what passes it is joined exactly.
BITS_PER_KEY, MOST_BITS = 128, 29
#: Lines of one key that are compared with all others of the key in one task.
SLICE = 128
#: Segments for each edit that are looked for before lines are compared.
PROBES = 8
#: Ends of lines whose distance is taken by the built-in function before.
END = 64


def within_edits(a: F.Column, b: F.Column, edits: int) -> F.Column:
    """Whether two strings, a not the longer one, are within `edits` (at most 4) edits.

    State after i characters of a: for each number e of errors, the set of diagonals d such
    that i characters of a and i + d of b are within e edits. Row i's match bits say on
    which diagonals the next characters agree; errors move bits down (a character of a is
    left out), up (one of b is left out) or keep them (one for the other).
    """
    if edits > 4:
        raise ValueError("the band of more than 4 edits does not fit a long")
    wide, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1

    def matches(there: F.Column) -> F.Column:
        """For each character of a its match bits; there: the characters of b, a lambda's variable, so that b is split once."""

        def bits(c: F.Column, i: F.Column) -> F.Column:
            one = [F.when(F.get(there, i + d) == c, F.lit(1 << (d + edits))).otherwise(F.lit(0)) for d in range(-edits, edits + 1)]
            return sum(one[1:], one[0]).cast("long")

        return F.transform(F.split(a, ""), bits)

    def step(state: F.Column, m: F.Column) -> F.Column:
        out, new, before = None, None, None
        for e in range(edits + 1):
            own = F.shiftright(state, wide * e).bitwiseAND(F.lit(full))
            moved = own.bitwiseAND(m)
            if e:
                moved = moved.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new, 1)).bitwiseAND(F.lit(full))
            new, before = moved, own
            packed = F.shiftleft(new, wide * e)
            out = packed if out is None else out.bitwiseOR(packed)
        return out

    start = sum(((1 << (edits + d)) << (wide * e)) for e in range(edits + 1) for d in range(e + 1))
    # split with an empty pattern gives one entry for each code point; an empty string gives one empty entry, which agrees with nothing
    rows = F.when(F.length(a) > 0, F.transform(F.array(F.split(b, "")), matches)[0]).otherwise(F.array().cast("array<bigint>"))
    last = F.aggregate(rows, F.lit(start).cast("long"), step)
    ends = F.call_function("shiftright", last, F.length(b) - F.length(a) + (wide * edits + edits)).bitwiseAND(F.lit(1)) == 1
    return (F.length(b) - F.length(a)).between(0, edits) & ends


def _segment(n: F.Column, i: int, edits: int) -> tuple[F.Column, F.Column]:
    """Start (from 0) and length of segment i of a line of n characters; the last n mod (edits + 1) are longer by one."""
    k = edits + 1
    base, long_from = F.floor(n / k).cast("int"), F.lit(k) - n % k
    return base * i + F.greatest(F.lit(i) - long_from, F.lit(0)), base + (F.lit(i) >= long_from).cast("int")


def segment_keys(wide: F.Column, edits: int) -> F.Column:
    """Index keys first (edits + 1 of them), then the keys to probe in shorter lines and shifted places.

    wide: the line in UTF-32, four bytes a character, so that a substring is found
    without counting characters from the line's start.
    """
    length = (F.octet_length(wide) / 4).cast("int")
    own, probes = [], []
    for shorter in range(edits + 1):
        n = length - shorter
        for i in range(edits + 1):
            start, size = _segment(n, i, edits)
            low = max(-i, shorter - (edits - i))
            high = min(i, shorter + (edits - i))
            for shift in range(low, high + 1):
                at = start + shift
                key = F.xxhash64(n, F.lit(i), F.substring(wide, at * 4 + 1, size * 4))
                if shorter == 0 and shift == 0:
                    own.append(key)
                else:
                    probes.append(F.when((at >= 0) & (at + size <= length), key))
    return F.array(*own, *probes)


def _cuts(a: F.Column, k: int) -> list[F.Column]:
    return [F.floor(F.length(a) * i / k).cast("int") for i in range(k + 1)]


def segments_held(a: F.Column, b: F.Column, edits: int) -> F.Column:
    """Whether b holds as many of PROBES * edits segments of a as it must, if it is within `edits` edits: all but `edits`."""
    k = max(1, PROBES * edits)
    cut = _cuts(a, k)
    held = [F.contains(b, F.substring(a, lo + 1, hi - lo)).cast("int") for lo, hi in zip(cut, cut[1:], strict=False)]
    return sum(held[1:], held[0]) >= k - edits


def _bound(value: F.Column, then) -> F.Column:
    """then(value), with value computed once: as a lambda's variable."""
    return F.transform(F.array(value), then)[0]


def linked(a: F.Column, b: F.Column, edits: int) -> F.Column:
    """within_edits of what differs: segments that both strings begin or end with are left out, which changes no distance."""
    k = 4 * PROBES

    def both(x: F.Column, y: F.Column) -> F.Column:
        return F.struct(x.alias("a"), y.alias("b"))

    def same(x: F.Column, part, begins) -> F.Column:
        """Characters of the longest run of x's segments, from one end, that y has there too."""
        cut = _cuts(x["a"], k)
        each = [F.when(begins(x["b"], part(x["a"], hi)), hi - lo).otherwise(F.lit(0)) for lo, hi in zip(cut, cut[1:], strict=False)]
        return sum(each[1:], each[0])

    def without_end(x: F.Column) -> F.Column:
        return _bound(same(x, F.right, F.endswith), lambda n: both(F.left(x["a"], F.length(x["a"]) - n), F.left(x["b"], F.length(x["b"]) - n)))

    begun = _bound(both(a, b), lambda x: _bound(same(x, F.left, F.startswith), lambda n: both(F.substring(x["a"], n + 1, F.length(x["a"])), F.substring(x["b"], n + 1, F.length(x["b"])))))
    return _bound(_bound(begun, without_end), lambda x: within_edits(x["a"], x["b"], edits))


def _lines(docs: DataFrame, min_chars: int, copy_chars: int) -> DataFrame:
    """doc_id, h, line_no, line for all lines of min_chars, and those of copy_chars that are not blank. docs: doc_id, h, text."""
    lines = docs.select("doc_id", "h", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "h", "line_no", F.trim(F.make_valid_utf8("line")).alias("line")).where((F.length("line") >= min_chars) | ((F.length("line") >= copy_chars) & F.col("line").rlike(r"\S")))


def _likely(keyed: DataFrame, live: DataFrame, n: int) -> DataFrame:
    """Rows of keyed whose key's bit is set in a bitmap of the n live keys: all that have a live key, and few others."""
    slots = 1 << max(15, min(MOST_BITS, math.ceil(math.log2(max(n, 1) * BITS_PER_KEY))))
    slot = F.pmod("key", F.lit(slots)) + 1
    bitmap = live.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    at = F.bitmap_bit_position(slot).cast("int")
    byte = F.ascii(F.decode(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    found = keyed.join(F.broadcast(bitmap), F.bitmap_bucket_number(slot) == F.col("part"))
    return found.where(F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1).select(*keyed.columns)


def _of_many(keyed: DataFrame, live: DataFrame, n: int) -> DataFrame:
    """Rows of keyed with one of n live keys, which are distinct: an inner join, as Spark would do a semi join before the bitmap's."""
    return _likely(keyed, live, n).join(live.hint("merge"), "key")


def line_links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """a, b: hashes of different lines that are linked; lines: one column `line`."""
    # the keys are a column of their own first: a projection computes what they share once, a generator would not
    # (outer, because the filter that Spark infers for a plain explode would compute them again)
    keyed = lines.select("line", F.encode("line", "UTF-32").alias("wide"))
    keyed = keyed.select("line", F.xxhash64("line").alias("id"), segment_keys(F.col("wide"), edits).alias("keys"))
    keyed = keyed.select("line", "id", F.posexplode_outer("keys").alias("nth", "key")).where("key IS NOT NULL")
    index = F.col("nth") <= edits
    by_key = keyed.select("key", "id", index.alias("index")).groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max("index").alias("index"))
    live = stored(by_key.where("index AND least < most").select("key"), "keys", merged=True)
    n_live = live.count()
    met = keyed.join(F.broadcast(live), "key", "left_semi") if n_live <= FEW_KEYS else _of_many(keyed, live, n_live)
    met = stored(met.groupBy("key", "id").agg(F.max(index).alias("index"), F.first("line").alias("line")), "members", merged=True)
    discard(live)

    # pairs of a shorter (or equal) indexed line a and a line b that probes it
    in_order = (F.length("a_line") < F.length("b_line")) | ((F.length("a_line") == F.length("b_line")) & (F.col("a") != F.col("b")))
    # lines within `edits` edits have ends within twice as many, and ends are short
    ends = [F.levenshtein(end("a_line", F.lit(END)), end("b_line", F.lit(END)), 2 * edits) >= 0 for end in (F.left, F.right)]
    near = segments_held(F.col("a_line"), F.col("b_line"), edits) & ends[0] & ends[1] & linked(F.col("a_line"), F.col("b_line"), edits)

    by_key = met.groupBy("key").agg(F.min(F.when(F.col("index"), F.struct(F.length("line").alias("n"), "id", "line"))).alias("hub"), F.count(F.lit(1)).alias("n"))
    hubs = stored(by_key.where("hub IS NOT NULL").select("key", F.col("hub.id").alias("a"), F.col("hub.line").alias("a_line"), "n"), "hubs", merged=True)
    other = met.select("key", F.col("id").alias("b"), F.col("line").alias("b_line"))
    pairs = sliced_join(other, hubs.drop("n"), "key", hubs.select("key", "n"), met.count(), "b", in_order & near)
    starred = stored(pairs.select("a", "b").distinct(), "line-links", merged=True)

    release(lines.sparkSession)
    label = starred.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
    named = met.join(label, "id", "left").withColumn("label", F.coalesce("to", "id")).drop("to")
    open_keys = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most AND n > 2").select("key", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    # a key of many lines is cut into slices, each in a task of its own with all lines of the key
    left = stored(named.join(open_keys, "key"), "open-lines", merged=True)
    a = left.where("index").select(F.pmod(F.col("id"), F.col("slices")).cast("int").alias("a_slice"), F.col("key").alias("a_key"), F.col("id").alias("a"), F.col("line").alias("a_line"), F.col("label").alias("a_label"))
    b = left.select(F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("b_slice"), F.col("key").alias("b_key"), F.col("id").alias("b"), F.col("line").alias("b_line"), F.col("label").alias("b_label"))
    on = (F.col("a_key") == F.col("b_key")) & (F.col("a_slice") == F.col("b_slice")) & in_order & (F.col("a_label") != F.col("b_label")) & near
    rest = a.join(b.hint("merge"), on).select("a", "b").distinct()
    return starred.unionAll(rest)


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, copy_chars: int | None = None) -> DataFrame:
    """doc_id, h, removed (sorted line numbers) for documents that lose lines. docs: doc_id, h, text."""
    lines = _lines(docs, min_chars, min_chars if copy_chars is None else copy_chars)
    place = F.struct("doc_id", "h", "line_no")
    places = stored(lines.select(F.xxhash64("line").alias("id"), "doc_id", "h", "line_no"), "lines")
    roots = connected(line_links(lines.where(F.length("line") >= min_chars).select("line"), edits)).withColumnRenamed("node", "id")
    # lines that occur once and are linked to none are nearly all; from here on only the others count
    copied = places.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    classed = copied.join(roots, "id", "full_outer").select("id", F.coalesce("root", "id").alias("class"), F.coalesce("n", F.lit(1)).alias("n"))
    met = stored(join_split(places, stored(classed, "classes", merged=True), "id", "n", places.count()).select("class", place.alias("place")), "repeats", merged=True)
    firsts = stored(met.groupBy("class").agg(F.min("place").alias("kept"), F.count(F.lit(1)).alias("n")), "firsts", merged=True)
    gone = join_split(met, firsts, "class", "n", met.count()).where(~F.col("place").eqNullSafe(F.col("kept"))).select("place.*")
    return gone.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id", copy_chars: int | None = None, counts: tuple[str, str] | None = None) -> DataFrame:
    """The rows of docs with repeated lines taken out of text.

    copy_chars: least length of lines that are removed as exact copies; None: min_chars.
    counts: names of two more columns, the numbers of lines before and after; docs must not have them.
    """
    if counts and set(counts) & set(docs.columns):
        raise ValueError(f"docs has a column named {sorted(set(counts) & set(docs.columns))}")
    doc, own_hash, hashed, gone_at = free(docs, "line_doc", "line_own_hash", "line_hash", "line_removed")
    h = F.xxhash64(docs[text])
    narrow = docs.select(docs[key].cast("long").alias("doc_id"), h.alias("h"), docs[text].cast("string").alias("text"))
    removed = repeated_lines(narrow, edits, min_chars, copy_chars).select(F.col("doc_id").alias(doc), F.col("h").alias(hashed), F.col("removed").alias(gone_at))
    own = docs.withColumn(own_hash, h)
    joined = own.join(removed, own[key].cast("long").eqNullSafe(F.col(doc)) & (F.col(own_hash) == F.col(hashed)), "left")
    gone, n = F.col(gone_at), F.coalesce(F.size(F.split(own[text], "\n", -1)), F.lit(0))
    # the lines are a lambda's variable, so that the text is split once
    left = F.transform(F.array(F.split(own[text], "\n", -1)), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n"))[0]
    out = [F.when(gone.isNull(), own[text]).otherwise(left).alias(c) if c == text else own[c] for c in docs.columns]
    if counts:
        out += [n.cast("long").alias(counts[0]), (n - F.when(gone.isNull(), 0).otherwise(F.size(gone))).cast("long").alias(counts[1])]
    return joined.select(*out)
