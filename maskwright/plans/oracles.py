"""DuckDB SQL for the queries of this package, over the same tables."""

from __future__ import annotations

from ..operators import detect, validate
from . import fixtures

# Patterns in DuckDB's dialect: no look-around, word characters of all scripts spelled out.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
EMAIL = r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\b"
IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
CARD = r"\b(?:[0-9][ -]?){12,18}[0-9]\b"
DATE = r"\b(?:[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2})\b"
PHONE = r"(^|[^\p{L}\p{N}_])(\+?\b(?:[0-9]{1,3}[ -.]?)?\(?[0-9]{3}\)?[ -.]?[0-9]{3}[ -.]?[0-9]{4}\b)"
_NUMBERED = "(order|ticket|invoice|reference|application|page|folio|table|serial)\\s+(no|num)"
_MONEY = "rs|rupees|usd|aud|inr|\\$"
_SCALES = "crore|lakh|million|billion"
# \\b knows ASCII letters only
_TECHNICAL = "(^|[^\\p{L}\\p{N}_])(iatf|iso|bs|en|page|order|invoice|ticket|reference|folio|application|no)([^\\p{L}\\p{N}_]|$)"

_LUHN = """(list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ({d}[len({d}) + 1 - i])::INT
  WHEN ({d}[len({d}) + 1 - i])::INT > 4 THEN 2 * ({d}[len({d}) + 1 - i])::INT - 9 ELSE 2 * ({d}[len({d}) + 1 - i])::INT END)) % 10 = 0)"""


def _blocks(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""lines AS (SELECT {key} AS doc_id, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) - 1 AS block_seq FROM {table}),
blocks AS (SELECT doc_id::BIGINT AS doc_id, block_seq::BIGINT AS block_seq, translate(line, chr(8211) || chr(8212) || chr(65533) || chr(9) || chr(160), '     ') AS text FROM lines WHERE regexp_matches(translate(line, chr(8211) || chr(8212) || chr(65533) || chr(9) || chr(160), '     '), '[^\\s]'))"""


def _spans(name: str, pattern: str, kind: str, where: str = "true", lead: bool = False) -> str:
    """name(doc_id, block_seq, entity_type, start, end, text, whole): matches with places; lead: the first group only says what stands before."""
    p = pattern.replace("'", "''")
    shift = f"len(regexp_extract(m[i], '{p}', 1))" if lead else "0"
    value = f"regexp_extract(m[i], '{p}', 2)" if lead else "m[i]"
    return f"""{name}_m AS (SELECT doc_id, block_seq, text AS whole, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM blocks WHERE regexp_matches(text, '{p}')),
{name}_i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name}_s AS (SELECT doc_id, block_seq, whole, {value} AS text, (list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) + {shift})::BIGINT AS start FROM {name}_i),
{name} AS (SELECT doc_id, block_seq, '{kind}' AS entity_type, start, (start + len(text))::BIGINT AS "end", text, whole FROM {name}_s WHERE {where})"""


_DIGITS = "regexp_replace(text, '[^0-9]', '', 'g')"
_LEFT = 'lower(whole[greatest(start - {n}, 0) + 1 : start])'
_NOT_NUMBERED = f"NOT regexp_matches({_LEFT.format(n=40)}, '{_NUMBERED}')"
_CARD_OK = f"len({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN.format(d=_DIGITS)} AND {_NOT_NUMBERED}"
_PHONE_OK = f"len({_DIGITS}) BETWEEN 7 AND 15 AND {_NOT_NUMBERED}"
_COLUMNS = 'doc_id, block_seq, entity_type, start, "end", text'


def _detected(read: str) -> str:
    """blocks and the candidates that these tables hold: c_email, c_phone, c_card, c_ip, c_date."""
    return ",\n".join([read, _spans("c_email", EMAIL, "EMAIL"), _spans("c_phone", PHONE, "PHONE_CANDIDATE", _PHONE_OK, lead=True), _spans("c_card", CARD, "CREDIT_CARD_CANDIDATE", _CARD_OK), _spans("c_ip", IPV4, "IP_CANDIDATE"), _spans("c_date", DATE, "DATE_CANDIDATE")])


_ALL = " UNION ALL ".join(f"SELECT * FROM {n}" for n in ("c_email", "c_phone", "c_card", "c_ip", "c_date"))
_CANONICAL = "CASE entity_type WHEN 'PHONE_CANDIDATE' THEN 'PHONE' WHEN 'CREDIT_CARD_CANDIDATE' THEN 'CREDIT_CARD' WHEN 'IP_CANDIDATE' THEN 'IP_ADDRESS' WHEN 'DATE_CANDIDATE' THEN 'DATE' ELSE entity_type END"
_STRENGTH = "CASE WHEN entity_type IN ('EMAIL', 'CREDIT_CARD', 'IP_ADDRESS') THEN 3 ELSE 2 END"
# Two spans overlap at most in pairs in these tables, so the fold is a comparison of each pair: the stronger stays, then the longer, then the earlier.
_FUSED = f"""{_detected(_blocks())},
named AS (SELECT doc_id, block_seq, {_CANONICAL} AS entity_type, start, "end", text, whole FROM ({_ALL})),
ranked AS (SELECT *, {_STRENGTH} AS strength FROM named),
fused AS (SELECT * FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE a.doc_id = b.doc_id AND a.block_seq = b.block_seq AND a.start < b."end" AND b.start < a."end"
  AND (a.start, a."end", a.entity_type) <> (b.start, b."end", b.entity_type)
  AND (b.strength, b."end" - b.start, -b.start) > (a.strength, a."end" - a.start, -a.start)))"""
_RIGHT = 'lower(whole["end" + 1 : "end" + 20])'
_JUDGED = f"""{_FUSED},
judged AS (SELECT *, CASE
    WHEN entity_type IN ('PHONE', 'CREDIT_CARD') AND (regexp_matches({_LEFT.format(n=20)}, '{_MONEY}') OR regexp_matches({_RIGHT}, '{_SCALES}')) THEN 'FINANCIAL_CONTEXT'
    WHEN entity_type = 'PHONE' AND regexp_matches({_LEFT.format(n=25)}, '{_TECHNICAL}') THEN 'TECHNICAL_STANDARD'
    ELSE 'GENUINE_PII' END AS reason FROM fused WHERE entity_type <> 'DATE'),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_seq ORDER BY start, "end", entity_type) AS ord FROM judged WHERE reason = 'GENUINE_PII')"""
_ENTITIES = f"""{_JUDGED},
keyed AS (SELECT doc_id, block_seq, ord, entity_type, text, lower(trim(text)) AS norm FROM kept),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type, norm ORDER BY block_seq, ord) AS nth FROM keyed),
ids AS (SELECT doc_id, entity_type, norm, text AS original, block_seq AS first_block, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY block_seq, ord) AS n FROM firsts WHERE nth = 1),
entities AS (SELECT doc_id, entity_type || '_' || CASE WHEN n > 999 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, '0') END AS id, entity_type, original, norm, first_block FROM ids)"""


def _draw(name: str, salt: str, n: int) -> str:
    return f"(('0x' || substr(md5({name} || '/' || {salt}), 1, 8))::BIGINT % {n})"


_OTHER = "list_aggregate(list_transform(string_split(original, ''), lambda c, i: CASE WHEN regexp_full_match(c, '[0-9]') THEN " + _draw("id", "'{s}' || (i - 1)::VARCHAR", 10) + "::VARCHAR ELSE c END), 'string_agg', '')"
_A, _B, _C = (_OTHER.replace("{s}", s) for s in "abc")
_IP = " || '.' || ".join(_draw("id", f"'o{i}'", 256) + "::VARCHAR" for i in range(4))

_TRUTH = f"""{_blocks()},
{_spans("t_email", EMAIL, "EMAIL")},
{_spans("t_ip", IPV4, "IP_ADDRESS")},
truth AS (SELECT doc_id, block_seq, entity_type, start, "end" FROM t_email UNION ALL SELECT doc_id, block_seq, entity_type, start, "end" FROM t_ip),
predicted AS (SELECT doc_id, block_seq, entity_type, start + (doc_id % 5 = 0)::INT AS start, "end" FROM truth WHERE doc_id % 3 <> 0),
scored AS (SELECT coalesce(t.entity_type, p.entity_type) AS entity_type, count(*) FILTER (WHERE t.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp,
  count(*) FILTER (WHERE t.doc_id IS NULL) AS fp, count(*) FILTER (WHERE p.doc_id IS NULL) AS fn
  FROM truth t FULL JOIN predicted p USING (doc_id, block_seq, entity_type, start, "end") GROUP BY 1)"""
# spans of a type do not overlap in these tables, so a prediction and the span that it was made from are the only pair
_OVERLAP = f"""{_TRUTH}, loose AS (SELECT t.entity_type, count(*) FILTER (WHERE p.doc_id IS NOT NULL) AS tp, 0::BIGINT AS fp, count(*) FILTER (WHERE p.doc_id IS NULL) AS fn
  FROM truth t LEFT JOIN predicted p ON t.doc_id = p.doc_id AND t.block_seq = p.block_seq AND t.entity_type = p.entity_type AND t.start < p."end" AND p.start < t."end" GROUP BY 1)"""
_P, _R = "coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tp / nullif(tp + fn, 0), 0)"


def _single(spans: str, name: str) -> str:
    return f"WITH {_blocks()},\n{spans}\nSELECT {_COLUMNS} FROM {name}"


def _count_types(read: str) -> str:
    return f"WITH {_detected(read)} SELECT entity_type, count(*) AS n FROM ({_ALL}) GROUP BY 1"


_TOKENS = _spans("tok", r"[^\s]+", "TOKEN")

# ---- fixtures -------------------------------------------------------------------------------
_STREETS = "|".join(detect.STREET_WORDS)
_COMPANY = rf"\b(?:[Ff]ormerly\s+)?(?:[A-Z][a-zA-Z0-9&]*\s+)+(?:(?:and|of|&)\s+)?(?:[A-Z][a-zA-Z0-9&]*\s+)*(?:{'|'.join(detect.COMPANY_ENDS)})\b"
_STREET = rf"\b[0-9]+[a-zA-Z]?(?:-[0-9]+[a-zA-Z]?)?\s+(?:[A-Z][a-zA-Z0-9.,-]*\s+){{1,4}}(?:{_STREETS})(?:,\s*[A-Z][a-zA-Z0-9.-]*(?:\s+[A-Z][a-zA-Z0-9.-]*)*){{0,3}}(?:\s*-?\s*[0-9]{{5,6}})?\b"
# without look-ahead: what ends the span is a group of its own
_OFFICE = r"()((?i)\b(?:Registered Office|Regd\.? Off\.?|Corporate Office)\s*:\s*[A-Z0-9][a-zA-Z0-9.,\-\s]{10,120})(?:\n|$|\.)"
_REGISTRY = r"(?i)\b(?:Registrar of Companies(?:,?\s*Central Processing Centre|\s*Maharashtra|,\s*Maharashtra)?|RoC)\b"
_PLACE = r"\b[A-Z][a-zA-Z]+(?:-[a-zA-Z]+)?(?:\s+[A-Z][a-zA-Z]+)*,\s*[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:-\s*)?[0-9]{5,6}\b"
_RARE_SPANS = ",\n".join(
    [
        _spans("f_ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "SSN_CANDIDATE"),
        _spans("f_six", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b", "IP_CANDIDATE"),
        _spans("f_date", DATE, "DATE"),
        _spans("f_registry", _REGISTRY, "COMPANY_CANDIDATE"),
        _spans("f_company", _COMPANY, "COMPANY_CANDIDATE"),
        _spans("f_street", _STREET, "ADDRESS"),
        _spans("f_office", _OFFICE, "ADDRESS", lead=True),
        _spans("f_place", _PLACE, "ADDRESS"),
    ]
)
_FIXTURE_SPANS = f"blocks AS (SELECT *, 0 AS block_seq FROM fixture),\n{_RARE_SPANS}"
_AROUND = """lower(whole[greatest(start - 50, 0) + 1 : start] || ' ' || whole["end" + 1 : "end" + 50])"""
_EDGE = " .,:;' || chr(10) || chr(13) || '"
_DETECT_FIXTURE = rf"""WITH {fixtures.sql("texts")},
{_FIXTURE_SPANS},
plain AS (SELECT * FROM f_ssn UNION ALL SELECT * FROM f_six UNION ALL SELECT * FROM f_registry UNION ALL SELECT * FROM f_company),
addresses AS (SELECT * FROM f_street UNION ALL SELECT * FROM f_office UNION ALL SELECT * FROM f_place),
cut AS (SELECT doc_id, (start + len(text) - len(ltrim(text, '{_EDGE}')))::BIGINT AS start, trim(text, '{_EDGE}') AS text FROM addresses)
SELECT doc_id, entity_type, start, "end", text FROM plain
UNION ALL SELECT doc_id, CASE WHEN regexp_matches({_AROUND}, 'birth|dob|born|d\.o\.b') THEN 'DATE_OF_BIRTH' ELSE 'DATE_CANDIDATE' END, start, "end", text FROM f_date
UNION ALL SELECT doc_id, 'ADDRESS', start, start + len(text), text FROM cut WHERE len(text) > 8"""

_S = "CASE WHEN {x}.k IN ('EMAIL', 'SSN', 'CREDIT_CARD', 'IP_ADDRESS') THEN 3 WHEN {x}.k IN ('DATE_OF_BIRTH', 'PHONE', 'DATE', 'ADDRESS') THEN 2 ELSE 1 END"
_CS, _RS = _S.format(x="c"), _S.format(x="r")
_SAME = "(c.k = r.k OR (c.k IN ('DATE', 'DATE_OF_BIRTH') AND r.k IN ('DATE', 'DATE_OF_BIRTH')))"
_WINS = f"""CASE WHEN c.k = 'DATE_OF_BIRTH' AND r.k = 'DATE' THEN true WHEN r.k = 'DATE_OF_BIRTH' AND c.k = 'DATE' THEN false
 WHEN r.s <= c.s AND c.e <= r.e AND (r.s < c.s OR c.e < r.e) THEN NOT {_SAME} AND {_CS} > {_RS}
 WHEN c.s <= r.s AND r.e <= c.e AND (c.s < r.s OR r.e < c.e) THEN {_SAME} OR {_CS} >= {_RS}
 WHEN {_CS} <> {_RS} THEN {_CS} > {_RS} WHEN c.p <> r.p THEN c.p > r.p WHEN c.e - c.s <> r.e - r.s THEN c.e - c.s > r.e - r.s
 WHEN c.s <> r.s THEN c.s < r.s ELSE c.k < r.k END"""
_CANONICAL_ALL = "CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' WHEN 'IP_CANDIDATE' THEN 'IP_ADDRESS' ELSE entity_type END"
_FUSE_FIXTURE = f"""WITH {fixtures.sql("spans")},
named AS (SELECT doc_id, {_CANONICAL_ALL} AS k, start AS s, "end" AS e, max(confidence) AS p, count(*) AS n FROM fixture GROUP BY ALL),
ranked AS (SELECT doc_id, {{'s': s, 'e': e, 'k': k, 'p': p, 'n': n}} AS c, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, {_S.format(x="named")} DESC, p DESC, k) AS o FROM named),
lists AS (SELECT doc_id, list(c ORDER BY o) AS l FROM ranked GROUP BY 1),
folded AS (SELECT doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, one: CASE
  WHEN len(list_filter(acc, lambda r: r.s < one[1].e AND one[1].s < r.e)) = len(list_filter(acc, lambda r: r.s < one[1].e AND one[1].s < r.e AND ({_WINS.replace('c.', 'one[1].')})))
  THEN list_concat(list_filter(acc, lambda r: NOT (r.s < one[1].e AND one[1].s < r.e)), one) ELSE acc END) AS l FROM lists)
SELECT doc_id, x.k AS entity_type, x.s::BIGINT AS start, x.e::BIGINT AS "end", x.p AS confidence, x.n AS n_sources FROM (SELECT doc_id, unnest(l) AS x FROM folded)"""


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_GENERIC = r"\b(" + "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in t) for t in validate.GENERIC_TERMS) + r")\b"
_VALIDATE_FIXTURE = rf"""WITH {fixtures.sql("contexts")},
placed AS (SELECT doc_id, entity_type, value AS text, text AS whole, position(value IN text) - 1 AS start, position(value IN text) - 1 + len(value) AS "end", lower(trim(value)) AS clean FROM fixture),
seen AS (SELECT *, list_slice(list_reverse(regexp_extract_all(lower(whole[1 : start]), '\w+')), 1, 5) AS five, lower(whole[greatest(start - 50, 0) + 1 : "end" + 50]) AS around FROM placed),
judged AS (SELECT doc_id, entity_type, text, CASE
  WHEN entity_type = 'PERSON' AND (list_contains({_list(validate.REGULATORS)}, clean) OR (list_contains({_list(validate.ROLES)}, clean)
    AND NOT list_has_any(regexp_extract_all({_LEFT.format(n=20)}, '\w+'), {_list(validate.TITLES)}))) THEN 'GENERIC_DOCUMENT_TERM'
  WHEN entity_type IN ('PHONE', 'CREDIT_CARD') AND (regexp_matches({_LEFT.format(n=20)}, '{_MONEY}') OR regexp_matches({_RIGHT}, '{_SCALES}')) THEN 'FINANCIAL_CONTEXT'
  WHEN entity_type = 'PHONE' AND regexp_matches({_LEFT.format(n=25)}, '{_TECHNICAL}') THEN 'TECHNICAL_STANDARD'
  WHEN entity_type = 'PERSON' AND len(list_intersect(regexp_extract_all(around, '\w+'), {_list(validate.ADDRESS_SIGNS)})) + regexp_matches(around, '\b[0-9]{{6}}\b')::INT >= 2 THEN 'ADDRESS_CONTEXT'
  WHEN entity_type IN ('PERSON', 'COMPANY', 'LOCATION') AND regexp_matches(clean, '{_GENERIC}') AND NOT list_has_any(five, {_list(validate.PERSONAL)}) THEN 'GENERIC_DOCUMENT_TERM'
  ELSE 'GENUINE_PII' END AS reason FROM seen)
SELECT doc_id, entity_type, text, CASE reason WHEN 'GENUINE_PII' THEN 'KEEP' ELSE 'REJECT' END AS decision, reason FROM judged"""

_STORE = rf"""{fixtures.sql("mentions")},
named AS (SELECT *, CASE WHEN entity_type = 'PERSON' THEN trim(regexp_replace(regexp_replace(lower(text), '\b(mr|ms|mrs|dr|shri|prof|shree)\b\.?', '', 'g'), '\s+', ' ', 'g')) ELSE lower(trim(text)) END AS norm FROM fixture),
ranked AS (SELECT *, (entity_type = 'PERSON' AND NOT contains(norm, ' ')) AS short, row_number() OVER (PARTITION BY doc_id, entity_type, norm ORDER BY block_seq, ord) AS nth FROM named),
firsts AS (SELECT * FROM ranked WHERE nth = 1),
fits AS (SELECT s.doc_id, s.norm, count(*) AS n, min(f.norm) AS full_name FROM firsts s JOIN firsts f ON s.doc_id = f.doc_id AND f.entity_type = 'PERSON' AND NOT f.short AND f.block_seq <= s.block_seq
  AND list_contains(string_split(f.norm, ' '), s.norm) WHERE s.short GROUP BY ALL HAVING count(*) = 1),
heads AS (SELECT f.*, row_number() OVER (PARTITION BY f.doc_id, f.entity_type ORDER BY f.block_seq, f.short, f.ord) AS k FROM firsts f LEFT JOIN fits a ON f.doc_id = a.doc_id AND f.norm = a.norm AND f.short WHERE a.norm IS NULL),
direct AS (SELECT doc_id, entity_type, norm, entity_type || '_' || lpad(k::VARCHAR, 3, '0') AS id, block_seq FROM heads),
keys AS (SELECT * FROM direct UNION ALL SELECT a.doc_id, 'PERSON', a.norm, d.id, f.block_seq FROM fits a JOIN direct d ON d.doc_id = a.doc_id AND d.entity_type = 'PERSON' AND d.norm = a.full_name JOIN firsts f ON f.doc_id = a.doc_id AND f.short AND f.norm = a.norm)"""
_OWNERS = rf"""WITH {_STORE},
asked AS (SELECT DISTINCT doc_id, norm, block_seq, string_split_regex(split_part(norm, '@', 1), '[._-]') AS parts FROM named WHERE entity_type = 'EMAIL'),
shared AS (SELECT e.doc_id, e.norm, e.block_seq, k.id, len(list_intersect(e.parts, string_split(k.norm, ' '))) AS n, len(list_distinct(string_split(k.norm, ' '))) AS size
  FROM asked e JOIN keys k ON k.doc_id = e.doc_id AND k.entity_type = 'PERSON' AND k.block_seq <= e.block_seq),
single AS (SELECT doc_id, norm, block_seq, min(id) AS id FROM shared WHERE n > 0 AND n >= least(2, size) GROUP BY ALL HAVING count(DISTINCT id) = 1)
SELECT s.doc_id, e.id AS email_id, arg_min(s.id, s.block_seq) AS person_id FROM single s JOIN direct e ON e.doc_id = s.doc_id AND e.entity_type = 'EMAIL' AND e.norm = s.norm GROUP BY 1, 2"""

# ---- propagation and rewriting on documents ----------------------------------------------------
_BODY = "list_transform(range(1, n), lambda i: (('0x' || substr(md5(id || '/d' || i::VARCHAR), 1, 8))::BIGINT % 10)::INT)"
_SUM = "list_sum(list_transform(range(1, n), lambda i: CASE WHEN (n - i) % 2 = 0 THEN body[i] WHEN body[i] > 4 THEN 2 * body[i] - 9 ELSE 2 * body[i] END))"
_FOUND = rf"""{_ENTITIES},
hits AS (SELECT b.doc_id, b.block_seq, b.text, e.entity_type, e.original, string_split(lower(b.text), lower(e.original)) AS g FROM blocks b JOIN entities e ON b.doc_id = e.doc_id AND contains(lower(b.text), lower(e.original))),
each AS (SELECT *, unnest(range(1, len(g))) AS i FROM hits),
here AS (SELECT *, (list_sum(list_transform(g[1:i], lambda x: len(x))) + (i - 1) * len(original))::BIGINT AS start FROM each),
found AS (SELECT doc_id, block_seq, entity_type, start, start + len(original) AS "end", text[start + 1 : start + len(original)] AS value FROM here
  WHERE NOT (regexp_matches(original, '^[\p{{L}}\p{{N}}]') AND start > 0 AND regexp_matches(text[start : start], '[\p{{L}}\p{{N}}_]'))
    AND NOT (regexp_matches(original, '[\p{{L}}\p{{N}}]$') AND regexp_matches(text[start + len(original) + 1 : start + len(original) + 1], '[\p{{L}}\p{{N}}_]')))"""
_MANIFEST = rf"""{_FOUND},
cards AS (SELECT *, len(regexp_replace(original, '[^0-9]', '', 'g')) AS n FROM entities WHERE entity_type = 'CREDIT_CARD'),
bodies AS (SELECT *, {_BODY} AS body FROM cards),
numbers AS (SELECT *, list_append(body, (10 - {_SUM}::INT % 10) % 10) AS number FROM bodies),
new_cards AS (SELECT doc_id, id, list_aggregate(list_transform(string_split(original, ''), lambda c, i: CASE WHEN regexp_full_match(c, '[0-9]') THEN number[len(regexp_replace(original[1:i], '[^0-9]', '', 'g'))]::VARCHAR ELSE c END), 'string_agg', '') AS synthetic FROM numbers),
made AS (SELECT e.doc_id, e.id, e.entity_type, e.norm, CASE e.entity_type WHEN 'IP_ADDRESS' THEN {_IP.replace("md5(id", "md5(e.id")} WHEN 'EMAIL' THEN 'user.' || substr(md5(e.id), 1, 10) || '@example.com'
  WHEN 'CREDIT_CARD' THEN c.synthetic ELSE CASE WHEN {_A} <> original THEN {_A} WHEN {_B} <> original THEN {_B} ELSE {_C} END END AS synthetic
  FROM entities e LEFT JOIN new_cards c ON e.doc_id = c.doc_id AND e.id = c.id),
spans AS (SELECT doc_id, block_seq, entity_type, start, "end", text AS original_text FROM kept UNION SELECT doc_id, block_seq, entity_type, start, "end", value FROM found),
manifest AS (SELECT s.doc_id, s.block_seq, s.entity_type, s.start, s."end", s.original_text, m.synthetic AS replacement_text FROM spans s JOIN made m ON m.doc_id = s.doc_id AND m.entity_type = s.entity_type AND m.norm = lower(trim(s.original_text)))"""
_MANIFEST = _MANIFEST.replace("md5(id || '/' || 'a'", "md5(e.id || '/' || 'a'").replace("md5(id || '/' || 'b'", "md5(e.id || '/' || 'b'").replace("md5(id || '/' || 'c'", "md5(e.id || '/' || 'c'")
_REDACTED = rf"""{_MANIFEST},
edits AS (SELECT m.*, b.text, coalesce(lag(m."end") OVER (PARTITION BY m.doc_id, m.block_seq ORDER BY m.start), 0) AS before FROM manifest m JOIN blocks b USING (doc_id, block_seq)),
spliced AS (SELECT doc_id, block_seq, string_agg(text[before + 1 : start] || replacement_text, '' ORDER BY start) || any_value(text)[max("end") + 1 :] AS redacted FROM edits GROUP BY 1, 2),
redacted AS (SELECT b.doc_id, b.block_seq, coalesce(s.redacted, b.text) AS redacted FROM blocks b LEFT JOIN spliced s USING (doc_id, block_seq))"""
_CRITICAL = "('PERSON', 'EMAIL', 'PHONE', 'CREDIT_CARD', 'SSN', 'IP_ADDRESS', 'DATE_OF_BIRTH')"
_HINTS = {
    "titled_name": r"\b(?:Mr\.|Ms\.|Mrs\.|Shri|Shree|Dr\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b",
    "company_name": r"\b[A-Z][a-zA-Z0-9&]*(?:\s+[A-Z][a-zA-Z0-9&]*){1,4}\s+(?:Limited|Private Limited|LLP|Corporation|Pvt\.\s+Ltd\.|Ltd\.)",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "mobile": r"\b(?:\+91|91)?[6789][0-9]{9}\b",
}
_MISSED = rf"""WITH {_JUDGED},
{", ".join(_spans(f"h_{n}", p, n) for n, p in _HINTS.items())},
hints AS ({" UNION ALL ".join(f"SELECT * FROM h_{n}" for n in _HINTS)})
SELECT doc_id, block_seq, entity_type AS hint, text, start, "end", CASE WHEN start > 30 THEN '...' ELSE '' END || whole[greatest(start - 30, 0) + 1 : "end" + 30] || CASE WHEN "end" + 30 < len(whole) THEN '...' ELSE '' END AS context
FROM hints h WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.doc_id = h.doc_id AND j.block_seq = h.block_seq AND j.start < h."end" AND h.start < j."end")"""

_SEEDED = f"""seeded AS (SELECT doc_id, coalesce(text || chr(10), '') || {_list(fixtures.SEEDS)}[doc_id % {len(fixtures.SEEDS)} + 1] AS text FROM documents WHERE doc_id IS NOT NULL),
{_blocks("seeded")}"""
_SEEDED_CANDIDATES = rf"""WITH {_detected(_SEEDED)},
{_RARE_SPANS},
addresses AS (SELECT * FROM f_street UNION ALL SELECT * FROM f_office UNION ALL SELECT * FROM f_place),
kinds AS (SELECT entity_type FROM c_email UNION ALL SELECT entity_type FROM c_phone UNION ALL SELECT entity_type FROM c_card UNION ALL SELECT entity_type FROM c_ip
  UNION ALL SELECT entity_type FROM f_ssn UNION ALL SELECT entity_type FROM f_six UNION ALL SELECT entity_type FROM f_registry UNION ALL SELECT entity_type FROM f_company
  UNION ALL SELECT CASE WHEN regexp_matches({_AROUND}, 'birth|dob|born|d\.o\.b') THEN 'DATE_OF_BIRTH' ELSE 'DATE_CANDIDATE' END FROM f_date
  UNION ALL SELECT entity_type FROM addresses WHERE len(trim(text, '{_EDGE}')) > 8)
SELECT entity_type, count(*) AS n FROM kinds GROUP BY 1"""

_KEYWORDS = f"""words AS (SELECT doc_id, block_seq, len(text) AS characters, CASE {' '.join(f"WHEN contains(lower(text), '{k}') THEN '{k}'" for k in ('director', 'email', 'phone', 'telephone', 'address', 'registered office', 'promoter', 'pan'))} END AS keyword FROM blocks),
ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_seq) AS k FROM words WHERE keyword IS NOT NULL) SELECT doc_id, block_seq, keyword, characters FROM ranks WHERE k <= 20"""

_N = "block_seq"


def _element_counts(name: str, where: str = "true") -> str:
    """name: the counts of files whose blocks are dealt to body, tables, headers and footers by block_seq."""
    runs = "((len(text) - 1) // 40 + 1)"
    of = lambda i, prefix: f"count(*) FILTER ({_N} % 4 = {i}) AS {prefix}paragraphs, coalesce(sum({runs}) FILTER ({_N} % 4 = {i}), 0)::BIGINT AS {prefix}runs"
    return f"""{name} AS (SELECT doc_id::VARCHAR AS file, {of(0, "")}, {of(1, "cell_")}, {of(2, "header_")}, {of(3, "footer_")},
  count(DISTINCT {_N} // 40) FILTER ({_N} % 4 = 1) AS tables, count(DISTINCT ({_N} // 40, ({_N} // 8) % 5)) FILTER ({_N} % 4 = 1) AS rows,
  count(DISTINCT ({_N} // 40, ({_N} // 8) % 5, ({_N} // 4) % 2)) FILTER ({_N} % 4 = 1) AS cells, count(DISTINCT {_N} // 16) FILTER ({_N} % 4 >= 2) AS sections
  FROM blocks WHERE {where} GROUP BY doc_id)"""


_TALL = " UNION ALL ".join("SELECT file, '{c}' AS count, {c} AS n FROM {t}".replace("{c}", c) for c in ("paragraphs", "tables", "cells", "sections", "header_paragraphs", "footer_paragraphs"))
_RUN_MAPPING = f"""WITH {_blocks()},
{_spans("c", EMAIL, "EMAIL")},
met AS (SELECT *, unnest(range(start // 40, ("end" - 1) // 40 + 1)) AS run_index FROM c)
SELECT doc_id, block_seq, start, "end", run_index, greatest(start - run_index * 40, 0) AS start_in_run, least("end" - run_index * 40, 40) AS end_in_run, whole[greatest(start, run_index * 40) + 1 : least("end", run_index * 40 + 40)] AS text_in_run FROM met"""

ORACLES: dict[str, str] = {
    "redact_repeated": f"WITH {_REDACTED} SELECT doc_id, block_seq, redacted, 2 * count(*) AS n FROM redacted GROUP BY ALL",
    "redact_without_ids": f"WITH {_REDACTED} SELECT block_seq, redacted, count(*) AS n FROM redacted GROUP BY ALL",
    "redact_one_id": f"""WITH {_MANIFEST}, told AS (SELECT DISTINCT m.doc_id % 10 AS doc_id, d.text, block_seq, entity_type, start, "end", original_text, replacement_text FROM manifest m JOIN documents d ON m.doc_id = d.doc_id)
SELECT doc_id, block_seq, entity_type, start, "end", original_text, replacement_text FROM told""",
    "truth_located": f"""WITH {_blocks()},
{_spans("c", EMAIL, "EMAIL")}
SELECT doc_id::VARCHAR AS document_hash, 'body / paragraph=' || block_seq || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END AS path, doc_id % 5 <> 0 AS found, doc_id % 5 <> 0 AS same_text, start, "end", text FROM c""",
    "element_counts": f"WITH {_blocks()}, {_element_counts('counts')} SELECT * FROM counts",
    "structure_check": f"""WITH {_blocks()}, {_element_counts('a')}, {_element_counts('b', 'doc_id % 3 <> 0 OR block_seq < 5')},
x AS ({_TALL.replace('{t}', 'a')}), y AS ({_TALL.replace('{t}', 'b')})
SELECT file, count, x.n AS before, y.n AS after, coalesce(x.n = y.n, false) AS same FROM x FULL JOIN y USING (file, count)""",
    "stage_counts": f"WITH {_JUDGED}, r AS (SELECT count(*) AS n FROM ({_ALL})), f AS (SELECT count(*) AS n FROM fused), j AS (SELECT count(*) FILTER (reason = 'GENUINE_PII') AS k, count(*) AS n FROM judged) SELECT r.n AS raw, f.n AS resolved, r.n - f.n AS merged, j.k AS kept, j.n - j.k AS rejected FROM r, f, j",
    "kept_by_type": f"WITH {_JUDGED} SELECT 'body' AS container, entity_type, count(*) AS n FROM kept GROUP BY ALL",
    "span_sources": f"""WITH {_JUDGED} SELECT doc_id, block_seq, start, "end", 'regex' AS detectors FROM kept""",
    "span_examples": f"""WITH {_JUDGED}, ranks AS (SELECT doc_id, block_seq, entity_type, start, "end", text, row_number() OVER (PARTITION BY entity_type ORDER BY doc_id, block_seq, start, "end") AS nth FROM kept) SELECT * FROM ranks WHERE nth <= 3""",
    "metrics_categories": f"""WITH {_TRUTH}, always AS (SELECT unnest(['PERSON', 'COMPANY', 'LOCATION', 'EMAIL', 'PHONE']) AS entity_type)
SELECT entity_type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM scored FULL JOIN always USING (entity_type)""",
    "metrics_unread_blocks": f"WITH {_TRUTH} SELECT entity_type, tp, fp, fn FROM scored UNION ALL SELECT 'PERSON', 0, 0, count(*) FROM truth",
    "run_mapping_checked": _RUN_MAPPING,
    "detect_model": f"WITH {_blocks()},\n{_spans('c', '[A-Z][a-z]{2,} [A-Z][a-z]{2,}', 'PERSON_CANDIDATE')}\nSELECT {_COLUMNS}, 0.85::DOUBLE AS confidence FROM c",
    "seeded_candidates": _SEEDED_CANDIDATES,
    "seeded_keyword_hints": f"WITH {_SEEDED}, {_KEYWORDS}",
    "detect_fixture": _DETECT_FIXTURE,
    "fuse_fixture": _FUSE_FIXTURE,
    "validate_fixture": _VALIDATE_FIXTURE,
    "alias_fixture": f"WITH {_STORE} SELECT doc_id, entity_type, norm, id FROM keys",
    "email_link_fixture": _OWNERS,
    "candidates_conversations": _count_types(_blocks("conversations", "conv_id", "text")),
    "propagate_spans": f'WITH {_FOUND} SELECT doc_id, block_seq, entity_type, start, "end", value AS text FROM found',
    "manifest": f'WITH {_MANIFEST} SELECT doc_id, block_seq, entity_type, start, "end", original_text, replacement_text FROM manifest',
    "redact_documents": f"WITH {_REDACTED} SELECT doc_id, block_seq, redacted FROM redacted",
    "assurance_gate": f"""WITH {_REDACTED}, leaked AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, original_text FROM manifest WHERE entity_type IN {_CRITICAL} AND len(trim(original_text)) > 3) o JOIN redacted r ON r.doc_id = o.doc_id AND contains(r.redacted, o.original_text))
SELECT count(*) AS total, count(*) FILTER (WHERE entity_type IN {_CRITICAL}) AS critical, count(*) FILTER (WHERE entity_type NOT IN {_CRITICAL}) AS contextual, any_value(l.n) AS leaks, 0::BIGINT AS unplaced, any_value(l.n) = 0 AS passed FROM manifest, leaked l""",
    "audit_missed": _MISSED,
    "blocks_scan": f"WITH {_blocks()} SELECT doc_id, block_seq, text FROM blocks",
    "detect_email": _single(_spans("c", EMAIL, "EMAIL"), "c"),
    "detect_ipv4": _single(_spans("c", IPV4, "IP_CANDIDATE"), "c"),
    "detect_card_luhn": _single(_spans("c", CARD, "CREDIT_CARD_CANDIDATE", _CARD_OK), "c"),
    "detect_phone": _single(_spans("c", PHONE, "PHONE_CANDIDATE", _PHONE_OK, lead=True), "c"),
    "number_context": f"WITH {_blocks()},\n{_spans('c', '[0-9]{3,}', 'N')}\nSELECT doc_id, block_seq, start, text AS number, len(text) BETWEEN 13 AND 19 AND {_LUHN.format(d='text')} AS luhn, {_LEFT.format(n=20)} AS before FROM c",
    "candidates_union_counts": _count_types(_blocks()),
    "candidates_pages": _count_types(_blocks("pages", "page_id", "html")),
    "fuse_resolved": f"WITH {_FUSED} SELECT {_COLUMNS} FROM fused",
    "validate_counts": f"WITH {_JUDGED} SELECT entity_type, CASE reason WHEN 'GENUINE_PII' THEN 'KEEP' ELSE 'REJECT' END AS decision, reason, count(*) AS n FROM judged GROUP BY ALL",
    "audit_disagreement": f"WITH {_JUDGED} SELECT 'regex' AS sources, count(*) AS n FROM kept HAVING count(*) > 0",
    "audit_rejections": f"""WITH {_JUDGED}, texts AS (SELECT reason, text, count(*) AS n FROM judged WHERE reason <> 'GENUINE_PII' GROUP BY ALL),
ranks AS (SELECT *, sum(n) OVER (PARTITION BY reason)::BIGINT AS total, row_number() OVER (PARTITION BY reason ORDER BY n DESC, text) AS k FROM texts) SELECT reason, text, n, total FROM ranks WHERE k <= 10""",
    "entity_ids": f"WITH {_ENTITIES} SELECT doc_id, id, entity_type, original, first_block FROM entities",
    "synthetic_values": f"WITH {_MANIFEST} SELECT m.doc_id, m.id, e.original, m.synthetic FROM made m JOIN entities e ON m.doc_id = e.doc_id AND m.id = e.id",
    "structure_counts": f"WITH {_blocks()} SELECT 'body' AS container, count(DISTINCT doc_id) AS documents, count(*) AS blocks, sum(len(text))::BIGINT AS characters FROM blocks",
    "keyword_hints": f"WITH {_blocks()}, {_KEYWORDS}",
    "fragmented_runs": f"""WITH {_blocks()}, runs AS (SELECT doc_id, block_seq, unnest(range(0, (len(text) - 1) // 40 + 1)) AS run_idx, text FROM blocks WHERE block_seq < 200),
cut AS (SELECT doc_id, block_seq, run_idx, text[run_idx * 40 + 1 : run_idx * 40 + 40] AS run_text_1 FROM runs),
pairs AS (SELECT *, lead(run_text_1) OVER (PARTITION BY doc_id, block_seq ORDER BY run_idx) AS run_text_2 FROM cut),
split AS (SELECT * FROM pairs WHERE regexp_matches(run_text_1, '[\\p{{L}}\\p{{N}}]$') AND regexp_matches(run_text_2, '^[\\p{{L}}\\p{{N}}]')),
ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_seq, run_idx) AS k FROM split) SELECT doc_id, block_seq, run_idx, run_text_1, run_text_2 FROM ranks WHERE k <= 10""",
    "run_mapping": _RUN_MAPPING,
    "metrics_strict": f"WITH {_TRUTH} SELECT entity_type, tp, fp, fn FROM scored",
    "metrics_overlap": f"WITH {_OVERLAP} SELECT entity_type, tp, fp, fn FROM loose",
    "metrics_normalised": f"WITH {_OVERLAP} SELECT entity_type, tp, fp, fn, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round(coalesce(2 * {_P} * {_R} / nullif({_P} + {_R}, 0), 0), 6) AS f1 FROM loose",
    "metrics_averages": f"""WITH {_TRUTH}, sums AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM scored),
each AS (SELECT {_P} AS p, {_R} AS r FROM scored), f AS (SELECT p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM each)
SELECT 'micro' AS kind, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round(coalesce(2 * {_P} * {_R} / nullif({_P} + {_R}, 0), 0), 6) AS f1 FROM sums
UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM f""",
    "metrics_tokens": f"""WITH {_TRUTH},
{_TOKENS},
marked AS (SELECT EXISTS (SELECT 1 FROM truth t WHERE t.doc_id = k.doc_id AND t.block_seq = k.block_seq AND t.start < k."end" AND k.start < t."end") AS a,
  EXISTS (SELECT 1 FROM predicted p WHERE p.doc_id = k.doc_id AND p.block_seq = k.block_seq AND p.start < k."end" AND k.start < p."end") AS b FROM tok k)
SELECT count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE NOT a AND NOT b) AS tn, count(*) FILTER (WHERE NOT a AND b) AS fp, count(*) FILTER (WHERE a AND NOT b) AS fn FROM marked""",
    "assurance_leaks": f"""WITH {_JUDGED}, originals AS (SELECT DISTINCT doc_id, entity_type, text FROM kept WHERE len(trim(text)) > 3)
SELECT entity_type, count(*) AS n FROM originals o JOIN blocks b ON o.doc_id = b.doc_id AND contains(b.text, o.text) GROUP BY 1""",
}
