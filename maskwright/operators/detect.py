"""Detectors: text to candidate spans, as one array column per block.

candidates: array<struct<entity_type, text, start, end, confidence, source>>. A detector
is a function from the text column to such an array; detect() concatenates those that are
registered and keeps repeats. Nothing is shuffled and no Python runs on the workers.
A pattern is searched only in texts that pass a cheap test which every match passes.

Defined cases: null, empty and blank texts have no candidates; texts of any length are
searched whole; rows that repeat give repeated results; columns of other names pass
through, a column `candidates` is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import holds_any, left_of, right_of, spans_of

CANDIDATES = "array<struct<entity_type:string,text:string,start:int,end:int,confidence:double,source:string>>"
Detector = Callable[[Column], Column]

# What counts as context, and the forms of the patterns.
DOB_WORDS = ("birth", "dob", "born", "date of birth", "d.o.b")
NUMBERED = ("order", "ticket", "invoice", "reference", "application", "page", "folio", "table", "serial")
STREET_WORDS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Boulevard", "Blvd", "Lane", "Ln", "Drive", "Dr", "Marg", "Bhavan", "Estate", "Phase", "Sector", "Block", "Plot")
COMPANY_ENDS = ("Limited", "Private Limited", "LLP", "Corporation", r"Pvt\.\s+Ltd\.", r"Ltd\.")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_NAME = r"[A-Z][a-zA-Z]+"
#: Repetitions of a group that a pattern follows: Java's matcher goes one call deeper for each, so none may be unbounded.
_MANY = 40

EMAIL = r"(?U)\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\b"
PHONE = r"(?U)(?<!\w)\+?\b(?:\d{1,3}[ -.]?)?\(?\d{3}\)?[ -.]?\d{3}[ -.]?\d{4}\b"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
# the last digit ends the span: a separator behind it is not part of a card number
CARD = r"(?U)\b(?:\d[ -]?){12,18}\d\b"
IPV4 = rf"(?U)\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
IPV6 = r"(?U)\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b"
DATE = r"(?U)\b(?:\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\b"
REGISTRY = r"(?iu)(?U)\b(?:Registrar of Companies(?:,?\s*Central Processing Centre|\s*Maharashtra|,\s*Maharashtra)?|RoC)\b"
COMPANY = rf"(?U)\b(?:[Ff]ormerly\s+)?(?:[A-Z][a-zA-Z0-9&]*\s+){{1,{_MANY}}}(?:(?:and|of|&)\s+)?(?:[A-Z][a-zA-Z0-9&]*\s+){{0,{_MANY}}}(?:{'|'.join(COMPANY_ENDS)})\b"
STREET = rf"(?U)\b\d+[a-zA-Z]?(?:-\d+[a-zA-Z]?)?\s+(?:[A-Z][a-zA-Z0-9.,-]*\s+){{1,4}}(?:{'|'.join(STREET_WORDS)})(?:,\s*[A-Z][a-zA-Z0-9.-]*(?:\s+[A-Z][a-zA-Z0-9.-]*){{0,{_MANY}}}){{0,3}}(?:\s*-?\s*\d{{5,6}})?\b"
OFFICE = r"(?iu)(?d)\b(?:Registered Office|Regd\.? Off\.?|Corporate Office)\s*:\s*[A-Z0-9][a-zA-Z0-9.,\-\s]{10,120}(?=\n|$|\.)"
PLACE_PIN = rf"(?U)\b{_NAME}(?:-[a-zA-Z]+)?(?:\s+{_NAME}){{0,{_MANY}}},\s*{_NAME}(?:\s+{_NAME}){{0,{_MANY}}}\s+(?:-\s*)?\d{{5,6}}\b"
_NUMBERED = r"(?:" + "|".join(NUMBERED) + r")\s+no|(?:" + "|".join(NUMBERED) + r")\s+num"
_EDGES = r"^[.,:; \n\r]+|[.,:; \n\r]+$"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def dob_context(text: Column, start: Column, end: Column, window: int = 50) -> Column:
    around = F.lower(F.concat(left_of(text, start, window), F.lit(" "), right_of(text, end, window)))
    return around.rlike("birth|dob|born|d\\.o\\.b")


def numbered_context(text: Column, start: Column, window: int = 40) -> Column:
    """An identifier, not a telephone or card number: 'invoice no ...'."""
    return F.lower(left_of(text, start, window)).rlike(_NUMBERED)


def luhn_valid(text: Column) -> Column:
    d = digits(text)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def _candidate(kind: Column | str, s: Column, confidence: Column | float, source: str = "regex") -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(kind.alias("entity_type"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), confidence.alias("confidence"), F.lit(source).alias("source"))


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def by_pattern(kind: str, pattern: str, confidence: float, keep: Callable[[Column, Column], Column] | None = None, source: str = "regex", holds: str | Callable[[Column], Column] | None = None) -> Detector:
    """A detector of all matches of a pattern for which keep(text, span) holds; holds: see spans_of."""

    def run(text: Column) -> Column:
        found = spans_of(text, pattern, holds)
        if keep is not None:
            found = F.filter(found, lambda s: keep(text, s))
        return F.transform(found, lambda s: _candidate(kind, s, confidence, source))

    return run


def _phone_kept(text: Column, s: Column) -> Column:
    return F.length(digits(s["text"])).between(7, 15) & ~numbered_context(text, s["start"])


def _card_kept(text: Column, s: Column) -> Column:
    return luhn_valid(s["text"]) & ~numbered_context(text, s["start"])


def dates(text: Column) -> Column:
    def one(s: Column) -> Column:
        birth = dob_context(text, s["start"], s["end"])
        return _candidate(F.when(birth, "DATE_OF_BIRTH").otherwise("DATE_CANDIDATE"), s, F.when(birth, 0.90).otherwise(0.50))

    return F.transform(spans_of(text, DATE, has_digit), one)


def _addresses(pattern: str, holds: str | Callable[[Column], Column]) -> Detector:
    """Spans without punctuation around them, longer than 8 characters."""

    def run(text: Column) -> Column:
        def cut(s: Column) -> Column:
            left = F.length(s["text"]) - F.length(F.regexp_replace(s["text"], r"^[.,:; \n\r]+", ""))
            clean = F.regexp_replace(s["text"], _EDGES, "")
            start = (s["start"] + left).cast("int")
            return F.struct(start.alias("start"), (start + F.length(clean)).cast("int").alias("end"), clean.alias("text"))

        trimmed = F.filter(F.transform(spans_of(text, pattern, holds), cut), lambda s: F.length(s["text"]) > 8)
        return F.transform(trimmed, lambda s: _candidate("ADDRESS", s, 0.90))

    return run


#: The built-in detectors, in the order in which their candidates count as found.
REGEX: dict[str, Detector] = {
    "email": by_pattern("EMAIL", EMAIL, 0.99, holds="@"),
    "phone": by_pattern("PHONE_CANDIDATE", PHONE, 0.85, _phone_kept, holds=has_digit),
    "ssn": by_pattern("SSN_CANDIDATE", SSN, 0.95, holds="-"),
    "card": by_pattern("CREDIT_CARD_CANDIDATE", CARD, 0.90, _card_kept, holds=has_digit),
    "ipv4": by_pattern("IP_CANDIDATE", IPV4, 0.95, holds=has_digit),
    "ipv6": by_pattern("IP_CANDIDATE", IPV6, 0.95, holds=":"),
    "date": dates,
    "registry": by_pattern("COMPANY_CANDIDATE", REGISTRY, 0.95),
    "company": by_pattern("COMPANY_CANDIDATE", COMPANY, 0.95, holds=holds_any("Limited", "LLP", "Corporation", "Ltd")),
    "street": _addresses(STREET, has_digit),
    "office": _addresses(OFFICE, ":"),
    "place_pin": _addresses(PLACE_PIN, ","),
}

_TITLED = r"(?U)\b(?:Mr|Ms|Mrs|Dr|Shri|Prof|Shree)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
# Place names.
PLACES = ("Pune", "Mumbai", "Bombay", "Maharashtra", "Delhi", "India", "Chakan", "Khed", "Birdewadi")
_GPE = r"(?U)\b(?:" + "|".join(PLACES) + r")\b"


def rule_names(text: Column) -> Column:
    """Stands in for a statistical name recogniser where none is plugged in: titled names and a short list of places."""
    persons = F.transform(spans_of(text, _TITLED, holds_any("Mr", "Ms", "Dr", "Shri", "Prof", "Shree")), lambda s: _candidate("PERSON_CANDIDATE", s, 0.85, "rules"))
    return F.concat(persons, F.transform(spans_of(text, _GPE, holds_any(*PLACES)), lambda s: _candidate("LOCATION_CANDIDATE", s, 0.70, "rules")))


_registered: dict[str, Detector] = {**REGEX, "names": rule_names}


def register(name: str, detector: Detector) -> None:
    """Adds a detector, or replaces one: any function from the text column to CANDIDATES (a model as a pandas UDF, say)."""
    _registered[name] = detector


def candidates(text: Column, detectors: dict[str, Detector] | None = None) -> Column:
    used = _registered if detectors is None else detectors
    return F.concat(*(d(text).cast(CANDIDATES) for d in used.values()))


def detect(blocks: DataFrame, detectors: dict[str, Detector] | None = None) -> DataFrame:
    return blocks.withColumn("candidates", candidates(F.col("text"), detectors))
