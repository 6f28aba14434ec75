"""The registered queries of the fact engine, one a family of operators, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import density, judging, llmjson
from factloom.functions import normalize as N
from factloom.operators import facts as facts_op
from factloom.operators import matching, pages, reconcile
from factloom.plans import reads, sql, views
from factloom.sources import files
from factloom.sources.store import Store, scratch_root

LEDGER, OTHER = "ledger_a", "ledger_d"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view's SQL over the driver tables; every table is a parameter, so nothing is registered in the session."""
    names = {t: _table(spark, sf_dir, t) for t in ("documents", "orders", "customer") if f" {t} " in f" {text} ".replace("\n", " ")}
    marked = text
    for t in names:
        marked = marked.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ").replace(f"FROM {t}\n", f"FROM {{{t}}}\n")
    return spark.sql(marked, **names)


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, views.SPARK_FACTS_SQL)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored facts over the ledgers."""
    rows = raw_facts(spark, sf_dir)
    return rows.select(
        "*",
        N.snake_case(F.col("subject")).alias("subject_normalized"),
        N.snake_case(F.col("attribute")).alias("attribute_normalized"),
        F.timestamp_seconds(F.col("created_seq") + 1_700_000_000).alias("created_at"),
        F.lit(None).cast("string").alias("conditions"),
        F.col("source_doc_id").alias("source_doc"),
    ).withColumn("claim_fingerprint", N.claim_fingerprint(F.col("subject_normalized"), F.col("attribute_normalized"), F.col("temporal_scope")))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a few input splits dealt to all cores; tables of many splits stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_view(spark, sf_dir, views.PAGES_SQL))


def scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_density(book_pages(spark, sf_dir))


def all_pairs(spark: SparkSession, sf_dir: str, fuzzy: bool = True) -> DataFrame:
    """Candidates among all ledgers: each document's facts against all."""
    rows = facts(spark, sf_dir)
    return matching.candidates(rows, rows, fuzzy=fuzzy)


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rule, and by the rule judge for the rest, over all candidate pairs."""
    from factloom.plugins import RuleJudge

    rows = facts(spark, sf_dir)
    at = F.timestamp_seconds(F.lit(1_800_000_000))
    return reconcile.judge_and_collect(all_pairs(spark, sf_dir), rows, RuleJudge(), at)


def corroborations(rows: DataFrame) -> DataFrame:
    """Exact-attribute pairs that the deterministic rule settles."""
    pairs = matching.candidates(rows, rows, fuzzy=False)
    made = reconcile.settle(reconcile.split_by_rule(pairs, rows), F.current_timestamp())
    return made.select("fact_id_1", "fact_id_2", "match_source", "agreement_strength")


def ledger_corroborations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which facts of two ledgers corroborate each other."""
    return corroborations(facts(spark, sf_dir).where(F.col("source_doc_id").isin(LEDGER, OTHER)))


PAIR = ["fact_id_1", "fact_id_2", "match_source", "match_hint"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# Normalisation --------------------------------------------------------------------------------------------------------


@query("norm_snake", f"SELECT p_partkey, {sql.snake('p_name')} AS name FROM part")
def norm_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", N.snake_case(F.col("p_name")).alias("name"))


@query("norm_subject", f"SELECT id, {sql.snake('subject')} AS once, {sql.snake(sql.snake('subject'))} AS twice FROM ({views.FACTS_SQL}) f")
def norm_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = N.snake_case(F.col("subject"))
    return raw_facts(spark, sf_dir).select("id", once.alias("once"), N.snake_case(once).alias("twice"))


@query("norm_scope", f"SELECT id, {sql.scope('temporal_scope')} AS scope FROM ({views.FACTS_SQL}) f")
def norm_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_facts(spark, sf_dir).select("id", N.temporal_scope(F.col("temporal_scope")).alias("scope"))


@query("norm_attribute", f"SELECT id, {sql.attribute('attribute')} AS attribute FROM ({views.FACTS_SQL}) f")
def norm_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_facts(spark, sf_dir).select("id", N.attribute_name(F.col("attribute")).alias("attribute"))


@query("fingerprint", f"SELECT id, claim_fingerprint FROM ({sql.FACTS}) f")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("id", "claim_fingerprint")


# Pages ----------------------------------------------------------------------------------------------------------------


@query("page_density", f"SELECT doc_id, page_number, density_score FROM ({sql.SCORED}) p")
def page_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pages(spark, sf_dir).select("doc_id", "page_number", "density_score")


@query("front_matter", f"SELECT doc_id, page_number, is_front_matter FROM ({sql.SCORED}) p")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pages(spark, sf_dir).select("doc_id", "page_number", "is_front_matter")


@query("page_validity", f"SELECT doc_id, page_number, length({sql.trim('text')}) >= 60 AS valid, length({sql.trim('text')}) >= 50 AS has_text FROM ({views.PAGES_SQL}) p")
def page_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.length(N.trimmed(F.col("text"))) >= pages.LEAST_VALID_CHARS
    return book_pages(spark, sf_dir).select("doc_id", "page_number", valid.alias("valid"), density.has_text(F.col("text")).alias("has_text"))


@query("page_gate", f"SELECT doc_id, page_number FROM ({sql.SCORED}) p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_number) <= 15")
def page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.gate(scored_pages(spark, sf_dir), pages.DEFAULT_GATE).select("doc_id", "page_number")


@query("gate_fallback", f"SELECT doc_id, page_number FROM ({sql.clean(sql.SCORED)}) p")
def gate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.drop_front_matter(scored_pages(spark, sf_dir)).select("doc_id", "page_number")


@query("top_pages", f"SELECT doc_id, page_number, density_score FROM ({sql.top(sql.SCORED, 6)}) p")
def top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.top_pages(scored_pages(spark, sf_dir)).select("doc_id", "page_number", "density_score")


@query("select_pages_topk", f"SELECT doc_id, page_number, density_score FROM ({sql.select(sql.SCORED, 15, 3)}) p")
def select_pages_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.select_pages(scored_pages(spark, sf_dir), pages.DEFAULT_GATE).select("doc_id", "page_number", "density_score")


@query("prompt_text", f"SELECT doc_id, page_number, md5(left(text, 2400)) AS prompt_md5 FROM ({views.PAGES_SQL}) p")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.prompt_text(book_pages(spark, sf_dir)).select("doc_id", "page_number", F.md5(F.col("prompt_text").cast("binary")).alias("prompt_md5"))


@query("table_counts", sql.TABLE_COUNTS)
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.table_counts(book_pages(spark, sf_dir))


@query("layout_text", sql.LAYOUT)
def layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names as boxes of three lines, with heights that differ a little inside a line."""
    words = _table(spark, sf_dir, "part").select(F.col("p_partkey"), F.posexplode(F.split("p_name", " ")).alias("word_no", "word"))
    top = F.col("word_no") % 3 * 20.0 + F.col("word_no") % 2
    boxes = words.select(
        F.col("p_partkey").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), "word_no",
        (F.col("word_no") * 10.0).alias("x0"), top.alias("y0"), (F.col("word_no") * 10.0 + 9).alias("x1"), (top + 8).alias("y1"), "word",
    )
    return files.layout_text(boxes).select(F.col("doc_id").cast("long").alias("p_partkey"), "text")


@query("telemetry_pages", sql.TELEMETRY)
def telemetry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.page_telemetry(scored_pages(spark, sf_dir), pages.DEFAULT_GATE)


# Extraction -----------------------------------------------------------------------------------------------------------


def exploded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = raw_facts(spark, sf_dir).transform(_as_replies)
    return llmjson.explode_facts(replies, "reply")


def _as_replies(rows: DataFrame) -> DataFrame:
    """The replies view over fact rows; its SQL has braces, so it is an expression here and not a query."""
    start = views.REPLIES_SQL.index("CASE CAST")
    end = views.REPLIES_SQL.index(" AS reply")
    o = views.REPLIES_SQL[views.REPLIES_SQL.index("concat('{\"subject\"") : views.REPLIES_SQL.index(" AS o\n")]
    return rows.withColumn("o", F.expr(o)).select("id", "page", F.expr(views.REPLIES_SQL[start:end]).alias("reply"))


@query("json_facts", f"SELECT id, fact_no, subject, attribute, value, confidence FROM ({sql.REPLY_FACTS}) r")
def json_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded_replies(spark, sf_dir).select("id", "fact_no", "subject", "attribute", "value", "confidence")


@query("facts_validate", sql.VALID_LINES)
def facts_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text as an attribute."""
    lines = F.posexplode(F.split("text", "\n")).alias("line_no", "attribute")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("subject"), F.col("lang").alias("value"), lines)
    return facts_op.valid(rows).select("doc_id", "line_no", F.length("attribute").cast("long").alias("attribute_chars"))


@query("fact_defaults", sql.DEFAULTS)
def fact_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded_replies(spark, sf_dir)
    group = F.when(F.col("fact_no") == 0, F.lit("g1"))
    return rows.select(
        "id", "fact_no", facts_op.confidence(F.col("confidence")).alias("confidence"), facts_op.evidence().alias("evidence_quote"),
        facts_op.group_id(F.lit("d"), F.col("page"), group).alias("group_id"),
    )


# Matching -------------------------------------------------------------------------------------------------------------


@query("attr_words", f"SELECT p_partkey, list_sort({sql.words('p_name')}) AS words FROM part")
def attr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.sort_array(judging.attribute_words(F.col("p_name"))).alias("words"))


@query("attrs_related", sql.ATTRS_RELATED)
def attrs_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    # At most one row a ledger: five distinct attributes whatever the data.
    names = facts(spark, sf_dir).select(F.col("attribute_normalized").alias("a")).distinct()
    other = names.withColumnRenamed("a", "b")
    return names.join(other, F.col("a") < F.col("b")).select("a", "b", judging.attributes_related(F.col("a"), F.col("b")).alias("related"))


@query("subjects_related", sql.SUBJECTS_RELATED)
def subjects_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation").select(N.snake_case(F.col("n_name")).alias("subject_normalized"))
    return matching.related_subjects(nations, nations)


@query("candidates_exact", f"SELECT {', '.join(PAIR)} FROM ({sql.CANDIDATES}) c WHERE match_source = 'structural'")
def candidates_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(spark, sf_dir, fuzzy=False).select(*PAIR)


@query("candidates_fuzzy", f"SELECT {', '.join(PAIR)} FROM ({sql.CANDIDATES}) c WHERE match_source = 'fuzzy'")
def candidates_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(spark, sf_dir).where("match_source = 'fuzzy'").select(*PAIR)


@query("candidates_all", f"SELECT {', '.join(PAIR)}, is_intra_document FROM ({sql.CANDIDATES}) c")
def candidates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(spark, sf_dir).select(*PAIR, "is_intra_document")


@query("candidates_top4", f"SELECT {', '.join(PAIR)}, new_source_doc_id FROM ({sql.top_candidates(sql.CANDIDATES)}) c")
def candidates_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.top_candidates(all_pairs(spark, sf_dir)).select(*PAIR, "new_source_doc_id")


@query("anti_judged", sql.ANTI_JUDGED)
def anti_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = all_pairs(spark, sf_dir)
    judged = pairs.where("match_source = 'structural'").select(F.col("fact_id_2").alias("fact_id_1"), F.col("fact_id_1").alias("fact_id_2"))
    return matching.not_judged(pairs, judged).select(*PAIR)


# Judging --------------------------------------------------------------------------------------------------------------


@query("corroborate_exact", f"SELECT fact_id_1, fact_id_2, match_source, agreement_strength FROM ({sql.JUDGED}) j WHERE corroborated AND match_source = 'structural'")
def corroborate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corroborations(facts(spark, sf_dir))


@query("corroborate_all", f"SELECT fact_id_1, fact_id_2, corroborated FROM ({sql.JUDGED}) j")
def corroborate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.split_by_rule(all_pairs(spark, sf_dir), facts(spark, sf_dir)).select("fact_id_1", "fact_id_2", "corroborated")


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, views.SPARK_JUDGE_REPLIES_SQL)


@query("judge_labels", f"SELECT id, {sql.relation('raw_type')} AS relation_type FROM ({views.JUDGE_REPLIES_SQL}) r")
def judge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_replies(spark, sf_dir).select("id", judging.relation_type(F.col("raw_type")).alias("relation_type"))


@query("judge_factors", f"SELECT id, {sql.factor('raw_factor', sql.relation('raw_type'))} AS reconciling_factor FROM ({views.JUDGE_REPLIES_SQL}) r")
def judge_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = judging.reconciling_factor(F.col("raw_factor"), judging.relation_type(F.col("raw_type")))
    return judge_replies(spark, sf_dir).select("id", factor.alias("reconciling_factor"))


@query("judge_json", sql.JUDGE_JSON)
def judge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements read from replies of all forms; replies without a relation give none."""
    said = judge_replies(spark, sf_dir).withColumn("form", F.length("id") % 5)
    read = said.select("id", llmjson.judgement(F.expr(views.JUDGE_JSON_REPLY)).alias("j")).where("j IS NOT NULL")
    relation = judging.relation_type(F.col("j.relation_type"))
    return read.select("id", relation.alias("relation_type"), judging.reconciling_factor(F.col("j.reconciling_factor"), relation).alias("reconciling_factor"), "j.explanation")


@query("relationships_all", f"SELECT fact_id_1, fact_id_2, relation_type, reconciling_factor, match_source, agreement_strength FROM ({sql.RELATIONSHIPS}) r")
def relationships_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships(spark, sf_dir).select("fact_id_1", "fact_id_2", "relation_type", "reconciling_factor", "match_source", "agreement_strength")


# Reads ----------------------------------------------------------------------------------------------------------------

FIRST_FACT = "ledger_a|cfcdigokpl|FY2015"


@query("rel_enriched", sql.ENRICHED)
def rel_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = reconcile.with_facts(relationships(spark, sf_dir), facts(spark, sf_dir), "left")
    return met.select("fact_id_1", "fact_id_2", "relation_type", F.col("fact_1.value").alias("value_1"), F.col("fact_2.value").alias("value_2"))


@query("rel_by_type", f"SELECT fact_id_1, fact_id_2 FROM ({sql.RELATIONSHIPS}) r WHERE relation_type = 'contradicts'")
def rel_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships(spark, sf_dir).where("relation_type = 'contradicts'").select("fact_id_1", "fact_id_2")


@query("rel_list_newest", f"SELECT fact_id_1, fact_id_2, relation_type FROM ({sql.RELATIONSHIPS}) r WHERE fact_id_1 LIKE '{OTHER}|%' OR fact_id_2 LIKE '{OTHER}|%' ORDER BY sha256(least(fact_id_1, fact_id_2) || '#' || greatest(fact_id_1, fact_id_2)) LIMIT 50")
def rel_list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest relationships across documents that touch one document; equal times are in order of ids."""
    rows = reads.list_relationships(relationships(spark, sf_dir), facts(spark, sf_dir), limit=50, cross_document=True, doc_id=OTHER)
    return rows.select("fact_id_1", "fact_id_2", "relation_type")


@query("rel_for_document", f"SELECT fact_id_1, fact_id_2, relation_type FROM ({sql.RELATIONSHIPS}) r WHERE fact_id_1 IN (SELECT id FROM ({sql.FACTS}) f WHERE source_doc_id = '{OTHER}') OR fact_id_2 IN (SELECT id FROM ({sql.FACTS}) f WHERE source_doc_id = '{OTHER}')")
def rel_for_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.touching_document(relationships(spark, sf_dir), facts(spark, sf_dir), OTHER)
    return found.select("fact_id_1", "fact_id_2", "relation_type")


@query("fact_neighbors_inner", sql.neighbours(FIRST_FACT, "JOIN"))
def fact_neighbors_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads.neighbours(relationships(spark, sf_dir), facts(spark, sf_dir), FIRST_FACT, "inner")
    return rows.select("other_id", "relation_type", F.col("target_fact.value").alias("value"))


@query("fact_neighbors_outer", sql.neighbours(FIRST_FACT, "LEFT JOIN"))
def fact_neighbors_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = facts(spark, sf_dir)
    rows = reads.neighbours(relationships(spark, sf_dir), known.where("source_doc_id <> 'ledger_c'"), FIRST_FACT, "left")
    return rows.select("other_id", "relation_type", F.col("target_fact.value").alias("value"))


ORACLES["fact_neighbors_outer"] = sql.neighbours(FIRST_FACT, "LEFT JOIN", "WHERE source_doc_id <> 'ledger_c'")


@query("fact_lookup", f"SELECT id, value, claim_fingerprint FROM ({sql.FACTS}) f WHERE id = '{FIRST_FACT}'")
def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.fact(facts(spark, sf_dir), FIRST_FACT).select("id", "value", "claim_fingerprint")


@query("fact_detail", f"SELECT n.*, (SELECT value FROM ({sql.FACTS}) f WHERE id = '{FIRST_FACT}') AS own_value FROM ({sql.neighbours(FIRST_FACT, 'JOIN')}) n")
def fact_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads.fact_detail(relationships(spark, sf_dir), facts(spark, sf_dir), FIRST_FACT)
    return rows.select("other_id", "relation_type", F.col("target_fact.value").alias("value"), F.col("fact.value").alias("own_value"))


@query("facts_by_document", f"SELECT id, page, created_seq FROM ({sql.FACTS}) f WHERE source_doc_id = '{LEDGER}' ORDER BY page, created_seq, id LIMIT 500")
def facts_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.list_facts(facts(spark, sf_dir), LEDGER).select("id", "page", "created_seq")


@query("facts_recent", f"SELECT id, created_seq FROM ({sql.FACTS}) f ORDER BY created_seq DESC, id LIMIT 500")
def facts_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.list_facts(facts(spark, sf_dir)).select("id", "created_seq")


@query("facts_search_server", f"SELECT id FROM (SELECT * FROM ({sql.FACTS}) f ORDER BY created_seq DESC, id LIMIT 500) t WHERE {sql.search(('subject', 'attribute', 'value', 'evidence_quote'), 'inflation')}")
def facts_search_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.list_facts(facts(spark, sf_dir), search=" Inflation ", limit_then_search=True).select("id")


@query("facts_search_client", f"SELECT id FROM ({sql.FACTS}) f WHERE {sql.search(('subject', 'attribute', 'value', 'evidence_quote', 'subject_normalized', 'attribute_normalized'), 'total_rev')}")
def facts_search_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.search_facts(facts(spark, sf_dir), "Total_Rev").select("id")


@query("fact_view", sql.FACT_VIEW)
def fact_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.fact_view(facts(spark, sf_dir))


@query("doc_list_with_counts", f"SELECT doc_id, CAST((SELECT count(*) FROM ({sql.FACTS}) f WHERE f.source_doc_id = d.doc_id) AS BIGINT) AS fact_count FROM ({sql.DOCS}) d")
def doc_list_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = facts(spark, sf_dir)
    docs = known.select(F.col("source_doc_id").alias("doc_id")).distinct().unionByName(spark.createDataFrame([("empty_ledger",)], "doc_id string"))
    return reads.documents_with_counts(docs, known)


@query("stats", f"SELECT CAST(6 AS BIGINT) AS documents, CAST((SELECT count(*) FROM ({sql.FACTS}) f) AS BIGINT) AS facts, CAST((SELECT count(*) FROM ({sql.RELATIONSHIPS}) r) AS BIGINT) AS relationships")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = facts(spark, sf_dir)
    docs = known.select(F.col("source_doc_id").alias("doc_id")).distinct().unionByName(spark.createDataFrame([("empty_ledger",)], "doc_id string"))
    return reads.stats(docs, known, relationships(spark, sf_dir))


@query("rel_type_counts", f"SELECT relation_type, reconciling_factor, CAST(count(*) AS BIGINT) AS n FROM ({sql.RELATIONSHIPS}) r GROUP BY relation_type, reconciling_factor")
def rel_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships(spark, sf_dir).groupBy("relation_type", "reconciling_factor").agg(F.count("*").alias("n"))


@query("match_source_counts", f"SELECT match_source, match_hint, CAST(count(*) AS BIGINT) AS n FROM ({sql.CANDIDATES}) c GROUP BY match_source, match_hint")
def match_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(spark, sf_dir).groupBy("match_source", "match_hint").agg(F.count("*").alias("n"))


@query("canonicals", f"SELECT DISTINCT 'subject' AS kind, subject AS name FROM ({sql.FACTS}) f UNION ALL SELECT DISTINCT 'attribute', attribute FROM ({sql.FACTS}) f")
def canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.canonicals(facts(spark, sf_dir))


@query("cascade_delete", f"SELECT fact_id_1, fact_id_2 FROM ({sql.RELATIONSHIPS}) r WHERE fact_id_1 NOT LIKE '{OTHER}|%' AND fact_id_2 NOT LIKE '{OTHER}|%'")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = facts(spark, sf_dir).where(F.col("source_doc_id") != OTHER).select("id")
    rows = relationships(spark, sf_dir)
    for c in ("fact_id_1", "fact_id_2"):
        rows = rows.join(kept.withColumnRenamed("id", c), c, "left_semi")
    return rows.select("fact_id_1", "fact_id_2")


@query("dangling_edges", f"SELECT fact_id_1, fact_id_2 FROM ({sql.RELATIONSHIPS}) r WHERE fact_id_1 LIKE '{OTHER}|%' OR fact_id_2 LIKE '{OTHER}|%'")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = facts(spark, sf_dir).where(F.col("source_doc_id") != OTHER)
    return reads.dangling(relationships(spark, sf_dir), kept).select("fact_id_1", "fact_id_2")


# Store ----------------------------------------------------------------------------------------------------------------


def filled_store(spark: SparkSession, sf_dir: str) -> Store:
    """A store in the shared folder with all ledgers, their facts and their relationships, and one ledger deleted."""
    store = Store(spark, scratch_root(spark, "store"))
    known = facts(spark, sf_dir)
    store.commit(documents=ledger_documents(known), facts=known)
    store.commit(relationships=relationships(spark, sf_dir))
    store.delete_document(OTHER)
    return store


def ledger_documents(known: DataFrame) -> DataFrame:
    named = known.groupBy(F.col("source_doc_id").alias("doc_id")).agg(F.countDistinct("page").cast("int").alias("page_count"))
    at = F.timestamp_seconds(F.lit(1_700_000_000)).alias("created_at")
    return named.select("doc_id", F.col("doc_id").alias("doc_name"), "page_count", F.col("page_count").alias("total_pages"), at)


@query("store_cascade_delete", sql.deleted(OTHER))
def store_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_store(spark, sf_dir).relationships().select("fact_id_1", "fact_id_2")


@query("store_reprocess", sql.replaced(OTHER))
def store_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and relationships by document after the deleted ledger's facts came back: its old relationships did not."""
    store = filled_store(spark, sf_dir)
    back = facts(spark, sf_dir).where(F.col("source_doc_id") == OTHER)
    store.commit(documents=ledger_documents(back), facts=back)
    counted = reads.documents_with_counts(store.documents().select("doc_id"), store.facts())
    edges = reads.relationship_counts(store.relationships(), store.facts())
    return counted.join(edges, "doc_id", "left").select("doc_id", F.col("fact_count").alias("facts"), F.coalesce("relationship_count", F.lit(0).cast("long")).alias("relationships"))
