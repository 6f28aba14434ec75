"""Views that give the engine's relations over the driver tables, as SQL that Spark and DuckDB read alike.

- pages: ``documents`` in books of twenty rows by id, a row a page;
- facts: yearly and quarterly sales by groups of customers as five ledgers that state the same measures in different
  words, units and period spellings. There are as many subjects as groups, so facts grow with the tables; one ledger
  states all of its facts of one subject, which so has an eighth of them;
- replies: extraction and judge replies made of facts, some fenced or cut off.
"""

from __future__ import annotations

PAGES_PER_BOOK = 20
CUSTOMERS_PER_GROUP = 25

PAGES_SQL = f"""
SELECT concat('book', CAST(doc_id - doc_id % {PAGES_PER_BOOK} AS STRING)) AS doc_id, CAST(doc_id % {PAGES_PER_BOOK} + 1 AS INT) AS page_number,
       text, CAST(doc_id % 4 AS INT) AS table_count, CAST(doc_id % 30 AS INT) AS table_row_count
FROM documents WHERE doc_id IS NOT NULL
"""

#: A row a ledger for each measure: four ledgers state years (q = 0), one states quarters.
_SPARK_ROWS = "explode(CASE WHEN q = 0 THEN array(1, 2, 4, 5) ELSE array(3) END)"
_DUCKDB_ROWS = "unnest(CASE WHEN q = 0 THEN [1, 2, 4, 5] ELSE [3] END)"


#: A name of ten letters for a group's number: no two have four letters in a row in common but by chance.
_NAME = "translate(left(md5(CAST(k AS STRING)), 10), '0123456789', 'ghijklmnop')"


def _facts(rows: str) -> str:
    return f"""
WITH sales AS (
  SELECT k, y, coalesce(q, 0) AS q, CAST(floor(CAST(sum(total) AS DOUBLE) / 1000.0) AS BIGINT) AS v
  FROM (SELECT CAST(floor(c_custkey / {CUSTOMERS_PER_GROUP}) AS BIGINT) AS k, year(o_orderdate) + 20 AS y, quarter(o_orderdate) AS q, CAST(o_totalprice AS DECIMAL(18, 2)) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey) AS o
  GROUP BY GROUPING SETS ((k, y), (k, y, q))),
named AS (
  SELECT k, y, q, v, doc_no, {_NAME} AS name, CAST(y AS STRING) AS yyyy, CAST(y - 2000 AS STRING) AS yy
  FROM (SELECT k, y, q, v, {rows} AS doc_no FROM sales) AS s),
raw AS (
  SELECT k, y, q, doc_no, name,
         CASE doc_no WHEN 1 THEN 'ledger_a' WHEN 2 THEN 'ledger_b' WHEN 3 THEN 'ledger_c' WHEN 4 THEN 'ledger_d' ELSE 'ledger_e' END AS doc,
         CASE doc_no WHEN 2 THEN 'Revenue from operations' WHEN 3 THEN 'Revenue' WHEN 5 THEN 'Headline inflation' ELSE 'Total revenue' END AS attribute,
         CASE doc_no WHEN 2 THEN concat(name, ' Limited') WHEN 5 THEN 'All regions' ELSE name END AS subject,
         CASE doc_no WHEN 2 THEN CAST(CAST(floor(v / 10.0 + 0.5) AS BIGINT) AS STRING)
                     WHEN 4 THEN CAST(CASE WHEN k % 3 = 0 THEN CAST(floor(v * 1.1) AS BIGINT) ELSE v END AS STRING)
                     WHEN 5 THEN concat(CAST(v % 90 AS STRING), '.5%') ELSE CAST(v AS STRING) END AS value,
         CASE doc_no WHEN 1 THEN 'INR million' WHEN 2 THEN 'INR Crore' WHEN 3 THEN 'million' WHEN 5 THEN '%' END AS unit,
         CASE doc_no WHEN 1 THEN concat('FY', yyyy) WHEN 2 THEN concat('FY', yy) WHEN 3 THEN concat('Q', CAST(q AS STRING), ' FY', yy)
                     WHEN 4 THEN concat(CAST(y - 1 AS STRING), '-', yy) ELSE yyyy END AS scope
  FROM named)
SELECT concat(doc, '|', name, '|', scope) AS id, doc AS source_doc_id, subject, attribute, value, unit, scope AS temporal_scope,
       concat_ws('_', doc, CAST(CAST(k % 7 + 1 AS INT) AS STRING), CASE WHEN q = 0 THEN NULL ELSE concat('q', CAST(q AS STRING)) END) AS extraction_group_id,
       CAST(k % 7 + 1 AS INT) AS page, CAST(0.5 + (k % 5) / 10.0 AS DOUBLE) AS confidence,
       CAST(doc_no AS BIGINT) * 1000000000 + (y - 2000) * 10000000 + k * 10 + q AS created_seq,
       concat(subject, ' reported ', attribute, ' of ', value) AS evidence_quote
FROM raw
"""


FACTS_SQL = _facts(_DUCKDB_ROWS)
SPARK_FACTS_SQL = _facts(_SPARK_ROWS)

REPLIES_SQL = f"""
SELECT id, page, CASE CAST(created_seq % 5 AS INT)
         WHEN 0 THEN concat('{{"facts":[', o, ']}}')
         WHEN 1 THEN concat('Here it is:\n```json\n{{"facts":[', o, ']}}\n```\nDone.')
         WHEN 2 THEN concat('{{"facts":[', o, ',{{"subject":"cut o')
         WHEN 3 THEN concat('[', o, ',', o, ']')
         ELSE concat('I found ', o, ' and also {{"note":1}} here') END AS reply
FROM (SELECT id, page, created_seq,
             concat('{{"subject":"', subject, '","attribute":"', attribute, '","value":"', value, '","confidence":',
                    CAST(page AS STRING), '.5,"evidence_quote":""}}') AS o
      FROM ({FACTS_SQL}) AS f) AS r
"""

_JUDGE_REPLIES = """
SELECT id, CASE CAST(created_seq % 6 AS INT) WHEN 0 THEN 'CORROBORATES' WHEN 1 THEN 'contradictory' WHEN 2 THEN ' Reconciled '
         WHEN 3 THEN 'RelationType.RECONCILED' WHEN 4 THEN 'unsure' ELSE NULL END AS raw_type,
       CASE CAST(created_seq % 11 AS INT) WHEN 0 THEN 'Forecast vs actual' WHEN 1 THEN 'period basis' WHEN 2 THEN 'rounding' WHEN 3 THEN 'TEMPORAL_SCOPE'
         WHEN 4 THEN 'subsidiary only' WHEN 5 THEN 'currency' WHEN 6 THEN 'adjusted figure' WHEN 7 THEN 'unknown_factor' WHEN 8 THEN ''
         WHEN 9 THEN 'standalone' ELSE NULL END AS raw_factor
FROM ({facts}) AS f
"""
JUDGE_REPLIES_SQL = _JUDGE_REPLIES.format(facts=FACTS_SQL)
SPARK_JUDGE_REPLIES_SQL = _JUDGE_REPLIES.format(facts=SPARK_FACTS_SQL)

#: What a judge said and the form of its reply.
JUDGE_JSON_SQL = f"SELECT id, raw_type, raw_factor, CAST(length(id) % 5 AS INT) AS form FROM ({JUDGE_REPLIES_SQL}) AS r"
#: The reply: strict JSON, fenced, with text around it, cut off after an open quote, without any JSON.
_SAID = """concat('"relation_type": "', raw_type, '", "reconciling_factor": "', coalesce(raw_factor, ''), '", "explanation": "')"""
JUDGE_JSON_REPLY = f"""
CASE form WHEN 0 THEN concat('{{', {_SAID}, 'because of ', id, '"}}')
          WHEN 1 THEN concat('Sure.
```json
{{', {_SAID}, 'because of ', id, '"}}
```')
          WHEN 2 THEN concat('I say {{', {_SAID}, 'because of ', id, '"}} and no more')
          WHEN 3 THEN concat('{{', {_SAID}, 'cut off here')
          ELSE 'I can not tell' END
"""
