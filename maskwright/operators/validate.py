"""Validation: each resolved span is kept or rejected by what stands around it.

validated: array<struct<entity_type, text, start, end, confidence, source, decision,
reason>>. Later rules overwrite the reason of earlier ones, nothing turns a rejection
back; rejected spans stay in the result. Places inside address-rejected spans come back
as spans of their own, at the end.

Defined cases: no spans give none; a text without words around a span rejects nothing by
that rule; null arrays stay null; ties and repeated spans are judged each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import bound, left_of, right_of, spans_of, strip, words_in

VALIDATED = "array<struct<entity_type:string,text:string,start:int,end:int,confidence:double,source:string,decision:string,reason:string>>"

# Words and phrases of the rules.
GENERIC_TERMS = (
    "offer", "prospectus", "board", "table", "anchor investors", "issue", "promoters", "red herring prospectus", "inr", "indian rupees",
    "rupees", "the republic of india", "republic of india", "general terms and abbreviations", "key financial", "currency", "usd", "u.s", "u.s.", "sweden", "sek", "krona",
    "european union", "eur", "euro", "indian standard time", "united states of america", "united states", "united states dollars", "promoter group", "promoter selling shareholders",
    "promoter selling shareholder", "reliance", "company", "net proceeds", "email", "the promoter selling", "basis of allotment", "selling", "fiscal", "fiscals", "pursuant", "floor",
    "bid", "a bid", "bid amount", "the bid amount", "mutual funds", "qib bidders", "bidders", "key managerial personnel", "key managerial", "personnel", "underwriters", "syndicate",
    "allotment", "bank", "bankers", "upi", "neft", "rtgs",
)
PERSONAL = ("mr", "ms", "mrs", "shri", "shree", "dr", "prof", "contact", "secretary", "officer", "chairman", "director", "person")
TITLES = ("mr", "ms", "mrs", "shri", "shree", "dr", "prof")
ADDRESS_SIGNS = ("village", "taluka", "district", "street", "road", "nagar", "pin", "postal", "maharashtra", "office")
TECHNICAL = ("iatf", "iso", "bs", "en", "page", "order", "invoice", "ticket", "reference", "folio", "application", "no")
MONEY = ("rs", "rupees", "usd", "aud", "inr", "$")
SCALES = ("crore", "lakh", "million", "billion")
REGULATORS = ("scra", "scrr", "icdr", "sebi", "bse", "nse", "rbi", "roc")
ROLES = ("director", "directors", "promoter", "promoters", "chairman", "board", "company", "registrar", "regulations", "act", "depositories act")
PLACES = ("pune", "mumbai", "bombay", "maharashtra", "delhi", "india", "chakan", "khed", "birdewadi")
PERSON_TAILS = ("company", "secretary", "officer", "director", "group", "shareholders", "shareholder")


def _literal(term: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


_GENERIC = r"(?U)\b(?:" + "|".join(map(_literal, GENERIC_TERMS)) + r")\b"
_MONEY = "|".join(map(_literal, MONEY))
_PLACES = r"(?iu)(?U)\b(?:" + "|".join(sorted(PLACES, key=len, reverse=True)) + r")\b"
_TAIL = r"(?iu)(?U)(?<=\S)(?:\s+[.,:;()]*(?:" + "|".join(PERSON_TAILS) + r")[.,:;()]*)+\s*$"
_PIN_NEXT = r"(?U)^[^a-zA-Z]*?\b\d{3}\s?\d{3}\b"


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def _last_words(text: Column, n: int) -> Column:
    words = words_in(text)
    return F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n))


def trimmed(c: Column) -> Column:
    """A person without words of office behind the name; cut by position, so text and place still agree."""
    clean = F.when(c["entity_type"] == "PERSON", F.regexp_replace(c["text"], _TAIL, "")).otherwise(c["text"])
    return F.struct(
        F.when(F.lower(strip(c["text"])).isin(*PLACES), "LOCATION").otherwise(c["entity_type"]).alias("entity_type"),
        clean.alias("text"),
        c["start"].alias("start"),
        (c["start"] + F.length(clean)).cast("int").alias("end"),
        c["confidence"].alias("confidence"),
        c["source"].alias("source"),
    )


def rules(text: Column, c: Column) -> list[tuple[Column, str]]:
    """(rejects, reason) in the order in which they apply."""
    kind, clean = c["entity_type"], F.lower(strip(c["text"]))
    prefix = F.lower(F.substring(text, F.lit(1), c["start"]))
    named = kind.isin("PERSON", "COMPANY", "LOCATION", "PERSON_CANDIDATE", "COMPANY_CANDIDATE", "LOCATION_CANDIDATE")
    generic = named & (clean.isin(*GENERIC_TERMS) | clean.rlike(_GENERIC)) & ~F.arrays_overlap(_last_words(prefix, 5), _strings(PERSONAL))
    around = F.lower(F.concat(left_of(text, c["start"], 50), c["text"], right_of(text, c["end"], 50)))
    signs = F.size(F.array_intersect(words_in(around), _strings(ADDRESS_SIGNS))) + around.rlike(r"(?U)\b\d{6}\b").cast("int")
    technical = F.arrays_overlap(words_in(F.lower(left_of(text, c["start"], 25))), _strings(TECHNICAL))
    money = F.lower(left_of(text, c["start"], 20)).rlike(_MONEY) | F.lower(right_of(text, c["end"], 20)).rlike("|".join(SCALES))
    untitled = ~F.arrays_overlap(words_in(F.lower(left_of(text, c["start"], 20))), _strings(TITLES))
    return [
        (generic, "GENERIC_DOCUMENT_TERM"),
        ((kind == "PERSON") & (signs >= 2), "ADDRESS_CONTEXT"),
        ((kind == "PHONE") & technical, "TECHNICAL_STANDARD"),
        (kind.isin("PHONE", "CREDIT_CARD") & money, "FINANCIAL_CONTEXT"),
        ((kind == "PERSON") & (clean.isin(*REGULATORS) | (clean.isin(*ROLES) & untitled)), "GENERIC_DOCUMENT_TERM"),
    ]


def _judged(text: Column, c: Column) -> Column:
    told = rules(text, c)
    # a null means that there are no words to look at: the rule does not reject
    reason = reduce(lambda otherwise, r: F.when(F.coalesce(r[0], F.lit(False)), r[1]).otherwise(otherwise), told, F.lit("GENUINE_PII"))
    names = ("entity_type", "text", "start", "end", "confidence", "source")
    return F.struct(*(c[n].alias(n) for n in names), F.when(reason == "GENUINE_PII", "KEEP").otherwise("REJECT").alias("decision"), reason.alias("reason"))


def _recovered(text: Column, c: Column) -> Column:
    """Places in a span that was taken for an address, each with a postal code right behind it."""

    def place(s: Column) -> Column:
        start, end = (c["start"] + s["start"]).cast("int"), (c["start"] + s["end"]).cast("int")
        return F.struct(F.lit("LOCATION").alias("entity_type"), s["text"].alias("text"), start.alias("start"), end.alias("end"), F.lit(0.90).alias("confidence"), F.lit("validator_recovery").alias("source"), F.lit("KEEP").alias("decision"), F.lit("GENUINE_PII").alias("reason"))

    return F.filter(F.transform(spans_of(c["text"], _PLACES), place), lambda p: right_of(text, p["end"], 25).rlike(_PIN_NEXT))


def validate(text: Column, resolved: Column) -> Column:
    judged = F.transform(F.transform(resolved, trimmed), lambda c: _judged(text, c))

    def with_places(judged: Column) -> Column:
        refused = F.filter(judged, lambda c: c["reason"] == "ADDRESS_CONTEXT")
        return F.concat(judged, F.array_distinct(F.flatten(F.transform(refused, lambda c: _recovered(text, c)))))

    return bound(judged, with_places).cast(VALIDATED)


def local_spans(text: Column, resolved: Column) -> Column:
    """What stays of a block's own spans: validated without plain dates, decisions KEEP only."""
    return F.filter(validate(text, F.filter(resolved, lambda c: c["entity_type"] != "DATE")), lambda c: c["decision"] == "KEEP")
