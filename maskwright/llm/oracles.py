"""DuckDB SQL for queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

from . import mixing

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+')"


def _words(column: str = "text") -> str:
    return _WORDS.format(t=_LOWER.format(t=column))


NEAR_DUPLICATES = f"""
WITH RECURSIVE cut AS (SELECT doc_id, {_words()} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM cut),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS v FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM each a JOIN each b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT p.doc_id, e.b FROM reached p JOIN edges e ON e.a = p.r),
firsts AS (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN firsts USING (doc_id)
"""

# A window of w words with at most two substitutions holds a run of words in place: as long as what is left, dealt to one run more than there are substitutions.
OVERLAPS = f"""
WITH items AS (SELECT item_id, w, len(w) AS m, least(13, len(w)) AS size, ceil(0.8 * least(13, len(w)) - 1e-9)::BIGINT AS need FROM (SELECT item_id, {_words()} AS w FROM benchmark) WHERE len(w) > 0),
runs AS (SELECT *, ceil(need / (size - need + 1))::BIGINT AS r FROM items),
docs AS (SELECT doc_id, {_words()} AS w FROM documents),
lengths AS (SELECT DISTINCT r FROM runs),
item_runs AS (SELECT item_id, r, unnest(range(0, m - r + 1)) AS q, w FROM runs),
item_grams AS (SELECT item_id, r, q, array_to_string(w[q + 1 : q + r], ' ') AS gram FROM item_runs),
doc_runs AS (SELECT doc_id, r, unnest(range(0, len(w) - r + 1)) AS p, w FROM docs, lengths WHERE len(w) >= r),
doc_grams AS (SELECT doc_id, r, p, array_to_string(w[p + 1 : p + r], ' ') AS gram FROM doc_runs),
met AS (SELECT DISTINCT doc_id, item_id, p - q AS shift FROM doc_grams JOIN item_grams USING (r, gram)),
laid AS (SELECT doc_id, item_id, shift, size, need, m, greatest(0, -shift) AS lo, least(m, len(d.w) - shift) AS hi, i.w AS own, d.w AS there FROM met JOIN items i USING (item_id) JOIN docs d USING (doc_id)),
same AS (SELECT *, list_transform(range(lo, hi), lambda x: (own[x + 1] = there[shift + x + 1])::INT) AS e FROM laid WHERE hi - lo >= size),
good AS (SELECT *, list_filter(range(0, hi - lo - size + 1), lambda k: list_sum(e[k + 1 : k + size]) >= need) AS g FROM same),
found AS (SELECT doc_id, item_id, shift + lo + g[1] AS start_word, shift + lo + g[-1] + size AS end_word, list_sum(e[g[1] + 1 : g[-1] + size])::BIGINT AS n_same, len(g)::BIGINT AS n_windows, m::BIGINT AS item_words FROM good WHERE len(g) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_same DESC, start_word, end_word - start_word DESC, n_windows DESC) AS k FROM found)
SELECT doc_id, item_id, start_word, end_word, n_same, n_windows, item_words FROM ranked WHERE k = 1
"""

_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"(?:{_KEYWORDS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
#: kind, pattern, what must hold of a match x.
_RULES = (
    ("assign", _ASSIGN, f"len(regexp_extract(x, '{_ASSIGN}', 1)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "len(x) >= 16"),
    ("hex", "[0-9a-f]+", "len(x) >= 32"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "true"),
    ("pem", "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", "true"),
)
_FOUND = " UNION ALL ".join(
    f"""SELECT doc_id, '{kind}' AS kind, {n} AS nth, start, start + len(x) AS stop FROM (SELECT doc_id, m[i] AS x, (list_sum(list_transform(g[1:i], lambda t: len(t))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda t: len(t))), 0))::BIGINT AS start
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM documents WHERE regexp_matches(text, '{p}')))) WHERE {cond}"""
    for n, (kind, p, cond) in enumerate(_RULES)
)
SECRETS = f"""
WITH found AS ({_FOUND}),
told AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) FILTER (nth < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans FROM found GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN told USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_near_duplicates": NEAR_DUPLICATES,
    "op4_decontamination": OVERLAPS,
    "op6_source_mix": mixing.oracle(),
    "op10_secret_scan": SECRETS,
}
