"""Fusion: candidates of a block to spans that do not overlap, inside one array column.

Types become canonical, candidates with equal place and type are merged (all sources
stay), then spans are taken in order of start, length, strength, confidence and type; one
that overlaps replaces what it overlaps if it wins against all of it, else it goes.

Defined cases: no candidates give no spans; candidates that repeat count once as spans and
each as a source; unknown types are their own in capitals and weakest; ties fall to the
type that sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import bound

# Canonical types by detector type, and how strong a type is (1 if not named).
CANONICAL = {
    "PERSON_CANDIDATE": "PERSON",
    "EMAIL_ADDRESS": "EMAIL",
    "PHONE_NUMBER": "PHONE",
    "PHONE_CANDIDATE": "PHONE",
    "US_SSN": "SSN",
    "SSN_CANDIDATE": "SSN",
    "CREDIT_CARD_CANDIDATE": "CREDIT_CARD",
    "IP_CANDIDATE": "IP_ADDRESS",
    "DATE_TIME": "DATE",
    "DATE_CANDIDATE": "DATE",
    "LOCATION_CANDIDATE": "LOCATION",
    "GPE": "LOCATION",
    "LOC": "LOCATION",
    "COMPANY_CANDIDATE": "COMPANY",
    "ORG": "COMPANY",
    "ADDRESS_CANDIDATE": "ADDRESS",
}
STRENGTH = {"EMAIL": 3, "SSN": 3, "CREDIT_CARD": 3, "IP_ADDRESS": 3, "DATE_OF_BIRTH": 2, "PHONE": 2, "DATE": 2, "ADDRESS": 2}

SOURCES = "array<struct<source:string,confidence:double,original_type:string>>"
RESOLVED = f"array<struct<entity_type:string,text:string,start:int,end:int,confidence:double,source:string,sources:{SOURCES}>>"
_RANKED = f"array<struct<start:int,less:int,weaker:int,doubt:double,entity_type:string,end:int,text:string,confidence:double,sources:{SOURCES}>>"


def _lookup(pairs: dict, key: Column, otherwise: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), otherwise)


def canonical(kind: Column) -> Column:
    return _lookup(CANONICAL, F.upper(kind), F.upper(kind))


def strength(kind: Column) -> Column:
    out = F.lit(1)
    for n in sorted(set(STRENGTH.values())):
        out = F.when(kind.isin(*(k for k, v in STRENGTH.items() if v == n)), n).otherwise(out)
    return out


def valid(text: Column, c: Column) -> Column:
    """A candidate's place is inside the text and holds what it says."""
    return (c["start"] >= 0) & (c["start"] < c["end"]) & (c["end"] <= F.length(text)) & (F.substring(text, c["start"] + 1, c["end"] - c["start"]) == c["text"])


def compatible(a: Column, b: Column) -> Column:
    return (a == b) | (a.isin("DATE", "DATE_OF_BIRTH") & b.isin("DATE", "DATE_OF_BIRTH"))


def overrides(c: Column, r: Column) -> Column:
    """Whether c takes the place of r, which it overlaps."""
    ct, rt = c["entity_type"], r["entity_type"]
    cs, rs = strength(ct), strength(rt)
    cl, rl = c["end"] - c["start"], r["end"] - r["start"]
    same = (c["start"] == r["start"]) & (c["end"] == r["end"])
    inside = (r["start"] <= c["start"]) & (c["end"] <= r["end"]) & ~same
    around = (c["start"] <= r["start"]) & (r["end"] <= c["end"]) & ~same
    crossing = F.struct(cs, c["confidence"], cl, r["start"]) > F.struct(rs, r["confidence"], rl, c["start"])
    tie = (cs == rs) & (c["confidence"] == r["confidence"]) & (cl == rl) & (c["start"] == r["start"]) & (ct < rt)
    return (
        F.when((ct == "DATE_OF_BIRTH") & (rt == "DATE"), True)
        .when((rt == "DATE_OF_BIRTH") & (ct == "DATE"), False)
        .when(inside, ~compatible(ct, rt) & (cs > rs))
        .when(around, compatible(ct, rt) | (cs >= rs))
        .otherwise(crossing | tie)
    )


def _merged(candidates: Column) -> Column:
    """Equal place and canonical type become one; its sources stand by falling confidence, then in the order found."""
    keyed = F.transform(
        candidates,
        lambda c, i: F.struct(c["start"].alias("start"), c["end"].alias("end"), canonical(c["entity_type"]).alias("entity_type"), (-c["confidence"]).alias("doubt"), i.alias("nth"), c["text"].alias("text"), c["source"].alias("source")),
    )

    def step(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        told = F.array(F.struct(c["source"].alias("source"), (-c["doubt"]).alias("confidence"), c["entity_type"].alias("original_type")))
        new = F.struct(c["start"].alias("start"), (c["start"] - c["end"]).alias("less"), (-strength(c["entity_type"])).alias("weaker"), c["doubt"].alias("doubt"), c["entity_type"].alias("entity_type"), c["end"].alias("end"), c["text"].alias("text"), (-c["doubt"]).alias("confidence"), told.alias("sources"))
        again = F.coalesce((last["start"] == c["start"]) & (last["end"] == c["end"]) & (last["entity_type"] == c["entity_type"]), F.lit(False))
        more = F.struct(*(last[n].alias(n) for n in ("start", "less", "weaker", "doubt", "entity_type", "end", "text", "confidence")), F.concat(last["sources"], told).alias("sources"))
        return F.when(again, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(acc, F.array(new))).cast(_RANKED)

    return F.aggregate(F.array_sort(keyed), F.array().cast(_RANKED), step)


def resolve(candidates: Column) -> Column:
    """RESOLVED, ordered by start, end and type."""

    def overlap(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def step(acc: Column, c: Column) -> Column:
        met = F.filter(acc, lambda r: overlap(r, c))
        wins = F.forall(met, lambda r: overrides(c, r))
        return F.when(wins, F.concat(F.filter(acc, lambda r: ~overlap(r, c)), F.array(c))).otherwise(acc)

    taken = F.aggregate(F.array_sort(_merged(candidates)), F.array().cast(_RANKED), step)
    ordered = F.array_sort(F.transform(taken, lambda s: F.struct(s["start"], s["end"], s["entity_type"], s["text"], s["confidence"], s["sources"])))
    return F.transform(ordered, lambda s: F.struct(s["entity_type"].alias("entity_type"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["confidence"].alias("confidence"), F.lit("fusion").alias("source"), s["sources"].alias("sources"))).cast(RESOLVED)


def guarded(candidates: Column, text: Column) -> Column:
    """candidates, or an error if one of them contradicts the text."""
    kind = "array<struct<entity_type:string,text:string,start:int,end:int,confidence:double,source:string>>"
    wrong = F.raise_error(F.lit("a candidate has invalid offsets or another text")).cast(kind)
    return bound(candidates, lambda c: F.when(F.forall(c, lambda x: F.coalesce(valid(text, x), F.lit(False))), c).otherwise(wrong))
