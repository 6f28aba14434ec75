"""DuckDB SQL with the meaning of the operators, for the registered queries.

Every list, weight and pattern is written out here again, so that a wrong one in the engine does not agree with itself.
"""

from __future__ import annotations

from factloom.plans import views

# Fixed values. --------------------------------------------------------------------------------------------------------
UNSPECIFIED = "unspecified"
CORPORATE = "limited|ltd|pvt_ltd|private_limited|inc|incorporated|corp|corporation|llc"
QUALIFIERS = "rate|ratio|total|value|figure|level|estimate"
SYNONYMS = {
    "pat": ("profit_after_tax", "profit_after_tax_loss", "net_profit", "net_loss", "restated_profit", "restated_loss",
            "restated_loss_for_the_period", "restated_loss_for_the_year", "restated_profit_loss"),
    "revenue": ("revenue_from_operations", "total_revenue", "total_income"),
    "gdp_growth": ("real_gdp_growth", "gdp_growth", "growth_in_real_gdp"),
    "cpi_inflation": ("headline_inflation", "cpi_inflation", "retail_inflation"),
    "fiscal_deficit": ("gross_fiscal_deficit",),
}
QUARTER = r"(q[1-4])\s*(?:of\s*)?(?:fy\s*)?([0-9]{2,4})"
YEAR_RANGE = r"(?:fy\s*)?([0-9]{4})[-/]([0-9]{2,4})"
FISCAL_YEAR = r"fy\s*([0-9]{2,4})"
CALENDAR_YEAR = r"\b(19[0-9][0-9]|20[0-9][0-9])\b"
FRONT_MATTER = ("table of contents", "contents\t", "contents\n", "abbreviations", "list of tables", "list of boxes", "preface", "acknowledgement")
DOT_LEADERS = (("...", 8), (". . .", 4))
NUMBER_WORD = r"\b[0-9]+(?:\.[0-9]+)?%?\b"
METRIC_TOKENS = r"(?i)(%|₹|\$|€|crore|million|billion|trillion|ratio|bps|growth|deficit|revenue|profit|loss|gdp|inflation|pat|ebitda|cpi)"
CORE_METRICS = r"(?i)\b(revenue|profit|loss|pat|pbt|ebitda|gdp|gva|cpi|wpi|inflation|growth|deficit|net worth|assets|liabilities|borrowings)\b"
STOP_WORDS = (
    "of in the and to for a an on as by at per from with average total net gross daily annual monthly quarterly "
    "number numbers share shares period year quarter value figure level rate ratio"
).split()
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"
MILLIONS, CRORES = ("million", "mn"), ("crore", "cr")
RELATIONS = (("corr", "corroborates"), ("cont", "contradicts"), ("rec", "reconciled"))
FACTORS = (
    ("projection_vs_actual", ("proj", "forecast", "target", "actual")),
    ("reporting_basis", ("restate", "basis", "consol", "standalone")),
    ("precision_or_rounding", ("round", "precis", "decimal")),
    ("temporal_scope", ("temp", "time", "period", "year", "quarter")),
    ("entity_scope", ("entity", "scope", "subsidiary")),
    ("unit_difference", ("unit", "curr", "scale")),
    ("definition_difference", ("def", "gaap", "adjusted", "standard")),
)
# ----------------------------------------------------------------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"


def snake(x: str) -> str:
    kept = rf"regexp_replace(coalesce({x}, ''), '[^\pL\pN_\s\pZ-]', '', 'g')"
    joined = rf"regexp_replace(regexp_replace({kept}, '[\s\pZ-]+', '_', 'g'), '_+', '_', 'g')"
    bare = rf"regexp_replace(lower(trim({joined}, '_')), '^(.+)_(?:{CORPORATE})$', '\1')"
    return f"coalesce(nullif(rtrim({bare}, '_'), ''), '{UNSPECIFIED}')"


def scope(x: str) -> str:
    s = f"lower({trim(x)})"

    def part(pattern: str, group: int) -> str:
        return f"regexp_extract({s}, {q(pattern)}, {group})"

    def year(pattern: str, group: int, base: str = "2000") -> str:
        n = f"TRY_CAST({part(pattern, group)} AS INT)"
        return f"CAST(CASE WHEN {n} < 100 THEN {n} + {base} ELSE {n} END AS VARCHAR)"

    century = f"TRY_CAST({part(YEAR_RANGE, 1)} AS INT) // 100 * 100"
    return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN '{UNSPECIFIED}'
      WHEN regexp_matches({s}, {q(QUARTER)}) THEN {part(QUARTER, 1)} || '_fy' || {year(QUARTER, 2)}
      WHEN regexp_matches({s}, {q(YEAR_RANGE)}) THEN 'fy' || {year(YEAR_RANGE, 2, century)}
      WHEN regexp_matches({s}, {q(FISCAL_YEAR)}) THEN 'fy' || {year(FISCAL_YEAR, 1)}
      WHEN regexp_matches({s}, {q(CALENDAR_YEAR)}) THEN 'cy' || {part(CALENDAR_YEAR, 1)}
      ELSE {snake(s)} END"""


def attribute(x: str) -> str:
    bare = rf"regexp_replace({snake(x)}, '^(.{{4,}})_(?:{QUALIFIERS})$', '\1')"
    cases = " ".join(f"WHEN {q(a)} THEN {q(b)}" for b, names in SYNONYMS.items() for a in names)
    return f"CASE {bare} {cases} ELSE {bare} END"


FACTS = f"""
SELECT *, concat({snake('subject_normalized')}, '::', {attribute('attribute_normalized')}, '::', {scope('temporal_scope')}) AS claim_fingerprint
FROM (SELECT *, {snake('subject')} AS subject_normalized, {snake('attribute')} AS attribute_normalized FROM ({views.FACTS_SQL}) AS raw_facts) AS named
"""

# Pages ----------------------------------------------------------------------------------------------------------------


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def _scored() -> str:
    t = trim("text")
    head = f"lower(array_to_string((string_split({t}, chr(10)))[1:6], chr(10)))"
    phrases = " OR ".join(f"contains({head}, {q(p)})" for p in FRONT_MATTER)
    dots = " OR ".join(
        f"(length(text) - length(replace(text, {q(d)}, ''))) / {len(d)} > {n}" for d, n in DOT_LEADERS
    )
    has_text = f"length({t}) >= 50"
    tokens = r"regexp_extract_all(text, '[^\s\pZ]+')"
    lines = f"string_split({t}, chr(10))"
    score = f"""len(list_filter({tokens}, lambda x: regexp_matches(x, '[0-9]'))) / len({tokens}) * 35.0
      + len(list_filter({lines}, lambda x: {_count('x', NUMBER_WORD)} >= 2)) / len({lines}) * 30.0
      + {_count('text', METRIC_TOKENS)} / len({tokens}) * 20.0
      + least(15.0, table_count * CAST(5.0 AS DOUBLE)) + least(10.0, table_row_count * CAST(0.5 AS DOUBLE))
      + least(25.0, {_count('text', CORE_METRICS)} * CAST(2.5 AS DOUBLE))"""
    return f"""
SELECT doc_id, page_number, text, is_front_matter,
       CAST(CASE WHEN {has_text} THEN floor(CASE WHEN is_front_matter THEN s * CAST(0.05 AS DOUBLE) ELSE s END * 100 + 0.5) / 100 ELSE 0.0 END AS DOUBLE) AS density_score
FROM (SELECT *, {has_text} AND ({phrases} OR {dots}) AS is_front_matter, CAST({score} AS DOUBLE) AS s
      FROM ({views.PAGES_SQL}) AS raw_pages WHERE {trim("coalesce(text, '')")} <> '') AS scored
"""


SCORED = _scored()
_HAS_TEXT = f"length({trim('text')}) >= 50"


def clean(pages: str) -> str:
    fit = f"(NOT is_front_matter AND {_HAS_TEXT})"
    return f"SELECT * EXCLUDE (kept) FROM (SELECT *, count(*) FILTER ({fit}) OVER (PARTITION BY doc_id) AS kept FROM ({pages}) AS a) AS b WHERE {fit} OR kept = 0"


def top(pages: str, k: int) -> str:
    return f"""
SELECT * EXCLUDE (n_valid, n_content) FROM (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_valid, count(*) FILTER (NOT is_front_matter) OVER (PARTITION BY doc_id) AS n_content
  FROM ({pages}) AS a WHERE length({trim('text')}) >= 60) AS b
WHERE n_valid <= {k} OR NOT is_front_matter OR n_content < {k}
QUALIFY n_valid <= {k} OR row_number() OVER (PARTITION BY doc_id ORDER BY density_score DESC, page_number) <= {k}
"""


def select(pages: str, gate: int, k: int) -> str:
    gated = f"SELECT * FROM ({pages}) AS g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_number) <= {gate}"
    sized = f"SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({clean(gated)}) AS c"
    return f"""SELECT * FROM (SELECT * EXCLUDE (n) FROM ({sized}) AS s WHERE n <= {k}
      UNION ALL SELECT * FROM ({top(f'SELECT * EXCLUDE (n) FROM ({sized}) AS s WHERE n > {k}', k)}) AS t) AS u WHERE {_HAS_TEXT}"""


TELEMETRY = f"""
SELECT doc_id, pages, front_matter_pages, short_pages, sent, greatest(0, pages - sent) AS skipped, pages / greatest(sent, 1) AS reduction
FROM (SELECT p.doc_id, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (is_front_matter) AS BIGINT) AS front_matter_pages,
             CAST(count(*) FILTER (NOT ({_HAS_TEXT})) AS BIGINT) AS short_pages, CAST(coalesce(any_value(sent), 0) AS BIGINT) AS sent
      FROM ({SCORED}) AS p LEFT JOIN (SELECT doc_id, count(*) AS sent FROM ({select(SCORED, 15, 3)}) AS x GROUP BY doc_id) AS c ON p.doc_id = c.doc_id
      GROUP BY p.doc_id) AS t
"""

# Replies --------------------------------------------------------------------------------------------------------------

_FENCE = r"'```(?:json)?\s*([\s\S]*?)\s*```'"
REPLY_FACTS = rf"""
SELECT id, page, CAST(i - 1 AS INT) AS fact_no, json_extract_string(os[i], '$.subject') AS subject, json_extract_string(os[i], '$.attribute') AS attribute,
       json_extract_string(os[i], '$.value') AS value, json_extract_string(os[i], '$.confidence') AS confidence,
       json_extract_string(os[i], '$.evidence_quote') AS evidence_quote
FROM (SELECT *, unnest(range(1, len(os) + 1)) AS i FROM (
  SELECT id, page, CASE WHEN whole IS NULL THEN list_filter([TRY_CAST(x AS JSON) FOR x IN regexp_extract_all(body, '\{{[^{{}}]*"subject"[^{{}}]*\}}') IF json_valid(x)],
                     lambda o: json_extract_string(o, '$.subject') IS NOT NULL AND json_extract_string(o, '$.value') IS NOT NULL)
                  WHEN whole LIKE '[%' THEN json_extract(whole, '$[*]') ELSE json_extract(whole, '$.facts[*]') END AS os
  FROM (SELECT *, CASE WHEN json_valid(body) AND regexp_matches(body, '^\s*[\[{{]') THEN body
                       WHEN cut <> '' AND json_valid(cut || ']}}') THEN cut || ']}}' WHEN cut <> '' AND json_valid(cut || '}}') THEN cut || '}}'
                       WHEN cut <> '' AND json_valid(cut || ']') THEN cut || ']' WHEN cut <> '' AND json_valid(cut) THEN cut END AS whole
        FROM (SELECT *, regexp_extract(body, '^([\s\S]*\}})', 1) AS cut
              FROM (SELECT id, page, CASE WHEN regexp_matches(reply, {_FENCE}) THEN regexp_extract(reply, {_FENCE}, 1) ELSE {trim('reply')} END AS body
                    FROM ({views.REPLIES_SQL}) AS r) AS b) AS c) AS w) AS l) AS f
"""

_SHORT = r"length({0}) <= 60 AND len(regexp_extract_all({0}, '[^\s\pZ]+')) <= 8"
VALID_LINES = f"""
SELECT doc_id, CAST(line_no - 1 AS INT) AS line_no, CAST(length(attribute) AS BIGINT) AS attribute_chars
FROM (SELECT doc_id, line_no, {trim("coalesce(source, '')")} AS subject, {trim("line")} AS attribute, {trim("coalesce(lang, '')")} AS value
      FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL) AS x) AS d
WHERE subject <> '' AND attribute <> '' AND value <> '' AND {_SHORT.format('value')} AND {_SHORT.format('attribute')}
"""

DEFAULTS = f"""
SELECT id, fact_no, greatest(0.0, least(1.0, coalesce(TRY_CAST(confidence AS DOUBLE), 0.85))) AS confidence,
       coalesce(nullif({trim("coalesce(evidence_quote, '')")}, ''), subject || ' ' || attribute || ': ' || value) AS evidence_quote,
       CASE WHEN fact_no = 0 THEN 'd_' || CAST(page AS VARCHAR) || '_g1' END AS group_id
FROM ({REPLY_FACTS}) AS r
"""

# Matching -------------------------------------------------------------------------------------------------------------


def words(x: str) -> str:
    stop = ", ".join(q(w) for w in STOP_WORDS)
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda w: NOT list_contains([{stop}], w))"


def _related_words(a: str, b: str) -> str:
    return f"(len(list_filter(list_intersect({a}, {b}), lambda w: length(w) >= 4)) > 0 OR len(list_intersect({a}, {b})) >= 2)"


def _related_subjects(a: str, b: str) -> str:
    n = 4
    parts = f"len(list_filter(list_intersect(string_split({a}, '_'), string_split({b}, '_')), lambda w: length(w) >= {n})) > 0"
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR (length({a}) >= {n} AND length({b}) >= {n} AND (contains({a}, {b}) OR contains({b}, {a}) OR {parts}))))"


ATTRS_RELATED = f"""
SELECT x.a AS a, y.a AS b, {_related_words(words('x.a'), words('y.a'))} AS related
FROM (SELECT DISTINCT attribute_normalized AS a FROM ({FACTS}) AS f) AS x, (SELECT DISTINCT attribute_normalized AS a FROM ({FACTS}) AS f) AS y WHERE x.a < y.a
"""
_NATIONS = f"(SELECT DISTINCT {snake('n_name')} AS s FROM nation)"
SUBJECTS_RELATED = f"SELECT a.s AS new_subject, b.s AS old_subject FROM {_NATIONS} AS a, {_NATIONS} AS b WHERE {_related_subjects('a.s', 'b.s')}"

CANDIDATES = f"""
WITH known AS MATERIALIZED ({FACTS}),
subjects AS (SELECT DISTINCT subject_normalized AS s FROM known),
subject_pairs AS MATERIALIZED (SELECT a.s AS s1, b.s AS s2 FROM subjects AS a, subjects AS b WHERE {_related_subjects('a.s', 'b.s')}),
attributes AS (SELECT a, {words('a')} AS ws FROM (SELECT DISTINCT attribute_normalized AS a FROM known) AS d),
attribute_pairs AS MATERIALIZED (SELECT a.a AS a1, b.a AS a2 FROM attributes AS a, attributes AS b WHERE a.a = b.a OR {_related_words('a.ws', 'b.ws')})
SELECT least(n.id, o.id) AS fact_id_1, greatest(n.id, o.id) AS fact_id_2,
       CASE WHEN n.attribute_normalized = o.attribute_normalized THEN 'structural' ELSE 'fuzzy' END AS match_source,
       CASE WHEN n.claim_fingerprint = o.claim_fingerprint THEN 'exact_scope' ELSE 'different_scope' END AS match_hint,
       n.source_doc_id = o.source_doc_id AS is_intra_document, n.source_doc_id AS new_source_doc_id,
       n.id AS new_id, o.id AS old_id, n.created_seq AS new_seq, o.created_seq AS old_seq
FROM known AS n JOIN subject_pairs AS p ON n.subject_normalized = p.s1 JOIN attribute_pairs AS t ON n.attribute_normalized = t.a1
     JOIN known AS o ON o.subject_normalized = p.s2 AND o.attribute_normalized = t.a2
WHERE n.created_seq > o.created_seq AND n.source_doc_id <> o.source_doc_id
  AND NOT coalesce(n.extraction_group_id <> '' AND n.extraction_group_id = o.extraction_group_id, false)
"""


def top_candidates(pairs: str) -> str:
    return f"""SELECT * FROM ({pairs}) AS p QUALIFY row_number() OVER (PARTITION BY new_source_doc_id
      ORDER BY CASE WHEN match_source = 'structural' THEN 0 ELSE 1 END, new_seq, new_id, old_seq DESC, old_id) <= 4"""


ANTI_JUDGED = f"""
SELECT fact_id_1, fact_id_2, match_source, match_hint FROM ({CANDIDATES}) AS c
WHERE NOT EXISTS (SELECT 1 FROM (SELECT fact_id_2 AS a, fact_id_1 AS b FROM ({CANDIDATES}) AS d WHERE match_source = 'structural') AS j
                  WHERE (a = fact_id_1 AND b = fact_id_2) OR (a = fact_id_2 AND b = fact_id_1))
"""

# Judging --------------------------------------------------------------------------------------------------------------


def _any(x: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def _close(x: str, y: str, base: str, share: float) -> str:
    return f"(abs({x} - {y}) <= 1.0 OR ({base} > 0 AND abs({x} - {y}) / {base} < {share}))"


JUDGED = f"""
SELECT *, coalesce(fp_1 <> '' AND fp_1 = fp_2 AND CASE WHEN v1 = v2 THEN units WHEN a IS NULL OR b IS NULL THEN false
         WHEN {_close('a', 'b', 'abs(a)', 0.005)} THEN units
         WHEN {_any('u1', MILLIONS)} AND {_any('u2', CRORES)} THEN {_close('(a / 10.0)', 'b', 'b', 0.01)}
         WHEN {_any('u1', CRORES)} AND {_any('u2', MILLIONS)} THEN {_close('a', '(b / 10.0)', '(b / 10.0)', 0.01)}
         ELSE false END, false) AS corroborated,
       floor(least(c1, c2) * 100 + 0.5) / 100 AS agreement_strength
FROM (SELECT *, u1 = '' OR u2 = '' OR u1 = u2 OR (contains(u1, 'million') AND contains(u2, 'million')) OR (contains(u1, 'crore') AND contains(u2, 'crore')) AS units,
             CASE WHEN regexp_matches(v1, {q(NUMBER)}) THEN TRY_CAST(v1 AS DOUBLE) END AS a, CASE WHEN regexp_matches(v2, {q(NUMBER)}) THEN TRY_CAST(v2 AS DOUBLE) END AS b
      FROM (SELECT c.fact_id_1, c.fact_id_2, c.match_source, c.match_hint, f.source_doc_id AS doc_1, g.source_doc_id AS doc_2,
                   f.claim_fingerprint AS fp_1, g.claim_fingerprint AS fp_2, f.value AS raw_1, g.value AS raw_2, f.confidence AS c1, g.confidence AS c2,
                   replace(lower(trim(f.value)), ',', '') AS v1, replace(lower(trim(g.value)), ',', '') AS v2,
                   lower(trim(coalesce(f.unit, ''))) AS u1, lower(trim(coalesce(g.unit, ''))) AS u2
            FROM ({CANDIDATES}) AS c JOIN ({FACTS}) AS f ON c.fact_id_1 = f.id JOIN ({FACTS}) AS g ON c.fact_id_2 = g.id) AS m) AS n
"""


def relation(x: str) -> str:
    t = f"lower(trim(coalesce({x}, '')))"
    cases = " ".join(f"WHEN contains({t}, {q(a)}) THEN {q(b)}" for a, b in RELATIONS)
    return f"CASE {cases} ELSE 'corroborates' END"


def factor(x: str, kind: str) -> str:
    f = f"lower(trim(coalesce({x}, '')))"
    cases = " ".join(f"WHEN {_any(f, stems)} THEN {q(name)}" for name, stems in FACTORS)
    return f"CASE WHEN {kind} <> 'reconciled' THEN 'none' {cases} ELSE 'none' END"


RELATIONSHIPS = f"""
SELECT fact_id_1, fact_id_2, match_source,
       CASE WHEN corroborated THEN 'corroborates' WHEN lower(trim(raw_1)) = lower(trim(raw_2)) THEN 'corroborates' WHEN why IS NOT NULL THEN 'reconciled' ELSE 'contradicts' END AS relation_type,
       CASE WHEN corroborated OR lower(trim(raw_1)) = lower(trim(raw_2)) OR why IS NULL THEN 'none' ELSE why END AS reconciling_factor,
       CASE WHEN corroborated THEN agreement_strength ELSE 1.0 END AS agreement_strength
FROM (SELECT *, CASE WHEN split_part(fp_1, '::', 3) <> split_part(fp_2, '::', 3) THEN 'temporal_scope'
                     WHEN split_part(fp_1, '::', 1) <> split_part(fp_2, '::', 1) THEN 'entity_scope'
                     WHEN u1 <> u2 AND u1 <> '' AND u2 <> '' THEN 'unit_difference'
                     WHEN split_part(fp_1, '::', 2) <> split_part(fp_2, '::', 2) THEN 'definition_difference'
                     WHEN round(TRY_CAST(replace(trim(raw_1), ',', '') AS DOUBLE)) = round(TRY_CAST(replace(trim(raw_2), ',', '') AS DOUBLE)) THEN 'precision_or_rounding' END AS why
      FROM ({JUDGED}) AS j) AS k
"""

ENRICHED = f"""
SELECT fact_id_1, fact_id_2, relation_type, f.value AS value_1, g.value AS value_2
FROM ({RELATIONSHIPS}) AS r LEFT JOIN ({FACTS}) AS f ON fact_id_1 = f.id LEFT JOIN ({FACTS}) AS g ON fact_id_2 = g.id
"""


def neighbours(fact: str, join: str, where: str = "") -> str:
    return f"""
SELECT other_id, relation_type, f.value AS value
FROM (SELECT *, CASE WHEN fact_id_1 = {q(fact)} THEN fact_id_2 ELSE fact_id_1 END AS other_id FROM ({RELATIONSHIPS}) AS r
      WHERE fact_id_1 = {q(fact)} OR fact_id_2 = {q(fact)}) AS m {join} (SELECT * FROM ({FACTS}) AS k {where}) AS f ON other_id = f.id
"""


def search(fields: tuple[str, ...], query: str) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({f}, '')), {q(query)})" for f in fields) + ")"


FACT_VIEW = f"""
SELECT id, subject, attribute, trim(concat_ws(' ', value, coalesce(unit, ''))) AS shown_value, coalesce(nullif(temporal_scope, ''), 'unspecified') AS shown_scope,
       CAST(floor(confidence * 100 + 0.5) AS INT) AS confidence_percent, source_doc_id AS source_doc, page
FROM ({FACTS}) AS f
"""

DOCS = f"SELECT DISTINCT source_doc_id AS doc_id FROM ({FACTS}) AS f UNION ALL SELECT 'empty_ledger'"

JUDGE_JSON = f"""
SELECT id, {relation('said')} AS relation_type, {factor('why', relation('said'))} AS reconciling_factor, explanation
FROM (SELECT id, CASE form WHEN 4 THEN NULL ELSE raw_type END AS said, CASE WHEN form = 3 THEN coalesce(nullif(raw_factor, ''), 'none') ELSE raw_factor END AS why,
             CASE form WHEN 3 THEN 'cut off here' ELSE 'because of ' || id END AS explanation
      FROM ({views.JUDGE_JSON_SQL}) AS j WHERE raw_type IS NOT NULL AND form <> 4) AS k
"""

TABLE_COUNTS = f"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (table_count > 0) AS BIGINT) AS pages_with_tables,
       CAST(sum(table_count) AS BIGINT) AS tables, CAST(sum(table_row_count) AS BIGINT) AS table_rows
FROM ({views.PAGES_SQL}) AS p WHERE {trim("coalesce(text, '')")} <> '' GROUP BY doc_id
"""


def deleted(doc: str) -> str:
    """Relationships after a document's facts are gone."""
    return f"SELECT fact_id_1, fact_id_2 FROM ({RELATIONSHIPS}) AS r WHERE fact_id_1 NOT LIKE '{doc}|%' AND fact_id_2 NOT LIKE '{doc}|%'"


def replaced(doc: str) -> str:
    """Facts and relationships by document after one was deleted and its facts were stored again."""
    left = deleted(doc)
    return f"""
SELECT f.source_doc_id AS doc_id, CAST(count(DISTINCT f.id) AS BIGINT) AS facts, CAST(count(DISTINCT e.pair) AS BIGINT) AS relationships
FROM ({FACTS}) AS f LEFT JOIN (SELECT unnest([fact_id_1, fact_id_2]) AS id, fact_id_1 || fact_id_2 AS pair FROM ({left}) AS d) AS e ON f.id = e.id
GROUP BY f.source_doc_id
"""


LAYOUT = """
SELECT p_partkey, trim(array_to_string(list_filter([array_to_string(list_filter(ws, lambda w, i: (i - 1) % 3 = k), ' ') FOR k IN range(3)], lambda x: x <> ''), chr(10))) AS text
FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part) AS p
"""
