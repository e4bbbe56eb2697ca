"""Queries over texts and names: tokens, keywords, intents, scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metascope.functions import text as t
from metascope.functions.constants import CODE_STOPWORDS, REGISTER_PREFIXES, REPORT_PHRASES, STRUCTURE_PHRASES, VALIDATION_MODULES, VALIDATION_PREFIXES, VALIDATION_SIGNALS
from metascope.operators import search
from metascope.plans import sql_text as s
from metascope.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
#: The questions of the registered queries.
QUESTION = "как проверить остатки складов при записи"
NAME = "ЖурналРецептур"


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = t.tokens_col(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(n).alias("tokens"), F.size(F.array_distinct(n)).alias("distinct_tokens"))


def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(t.normalize_col(F.col("text")).cast("binary")).alias("normalized_md5"))


def doc_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(t.keywords_col(F.col("text")), " ").alias("keywords"))


def keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    kw = t.keywords(QUESTION)
    stems = F.when(t.mentions_col(F.col("text"), kw), t.stems_col(F.col("text"))).otherwise(F.expr("cast(array() as array<string>)"))
    once = lambda c, name: F.inline(F.array(F.struct(c.alias(name))))  # noqa: E731  # out of a generator, so that no mention computes it again
    st = table(spark, d, "documents").select("doc_id", once(stems, "st")).select("doc_id", "st", once(F.array_join("st", " "), "joined"))
    return st.select("doc_id", once(F.round(t.overlap_col(F.col("st"), kw, " ".join(kw), F.col("joined")), 6), "score"))


def lexical_rank(spark: SparkSession, d: str) -> DataFrame:
    return keyword_overlap(spark, d).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").filter("kind = 'metadata' and object_name is not null").select("config_id", "object_type", "object_name").distinct()


def name_specificity(spark: SparkSession, d: str) -> DataFrame:
    kw = t.keywords(NAME, ())
    n = _names(spark, d).select("config_id", "object_type", "object_name", t.stems_col(F.col("object_name")).alias("st"))
    return n.select("config_id", "object_type", "object_name", F.round(t.specificity_col(F.col("st"), kw, " ".join(kw)), 6).alias("score"))


def identifier_match(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("config_id", "object_type", "object_name", F.round(t.identifier_col(F.col("object_name"), NAME), 6).alias("score"))


def classify_first_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.object_type_col(F.col("text")).alias("object_type"))


def intent_flags(spark: SparkSession, d: str) -> DataFrame:
    once = lambda c, name: F.inline(F.array(F.struct(c.alias(name))))
    rows = table(spark, d, "documents").select("doc_id", once(t.normalize_col(F.col("text")), "n")).select("doc_id", "n", once(t.stems_of(F.col("n")), "st"))
    rows = rows.select("doc_id", "n", t.keywords_of(F.col("st")).alias("k"), t.keywords_of(F.col("st"), CODE_STOPWORDS).alias("c"))
    return rows.select(
        "doc_id", t.contains_any_col(F.col("n"), STRUCTURE_PHRASES).alias("structural"), t.contains_any_col(F.col("n"), REPORT_PHRASES).alias("report"),
        (t.akin_count_col(F.col("c"), VALIDATION_PREFIXES) >= 2).alias("validation"), t.akin_any_col(F.col("k"), REGISTER_PREFIXES).alias("register"),
        (t.contains_any_col(F.col("n"), STRUCTURE_PHRASES) | (F.size("k") >= 2)).alias("navigation"),
    )


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Q1, Q2 for every eval item: the keyword phrase, the compact form and the phrase of the first eight."""
    k = table(spark, d, "eval_items").select("item_id", t.keywords_col(F.col("text")).alias("k"))
    return k.select("item_id", F.array_join("k", " ").alias("phrase"), F.array_join("k", "").alias("compact"), F.array_join(F.slice("k", 1, 8), " ").alias("short_phrase"))


def alias_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many of the question's words find a partner among the words of each object's name."""
    q = F.array(*[F.lit(x) for x in t.keywords("журналы рецептура плановых складов")])
    return _names(spark, d).select("config_id", "object_type", "object_name", t.alias_overlap_col(q, t.stems_col(F.col("object_name"))).alias("hits"))


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "diagnostics").distinct().groupBy(t.severity_col(F.col("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("findings"))


#: A question about checks, which asks for stock and for what is below zero.
CHECK_QUESTION = "проверить контроль остатков при отрицательном количестве"


def rule_score(spark: SparkSession, d: str) -> DataFrame:
    """F8: what the signals of a question about checks are worth for each method."""
    c = table(spark, d, "chunks").filter("chunk_type = 'code'").select("id", "module_type", "module_path", "method_name", "document").distinct()
    rows = search.scored(search.prepared(c, "method_name", "module_path", "document"), search.signal_parts(search.Question(CHECK_QUESTION)))
    return rows.select("id", "method_name", "module_path", "score").distinct()


def anchor_score(spark: SparkSession, d: str) -> DataFrame:
    """what the anchors of a question are worth for each object."""
    c = table(spark, d, "chunks").filter("chunk_type = 'metadata'").select("config_id", "object_type", "object_name", "synonym").distinct()
    return search.scored(search.prepared(c, "object_name", "synonym"), search.anchor_parts(search.Question(ANCHOR_QUESTION)))


#: A question with several anchors.
ANCHOR_QUESTION = "цены товаров по договорам с контрагентом"


def code_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Q2, Q5: the queries that are asked for one question about code."""
    q = search.Question("почему нельзя провести документ проверка остатков товара")
    return spark.createDataFrame([(i, x) for i, x in enumerate(q.code_retrieval(), 1)], "place int, query string")


QUERIES: dict[str, Query] = {f.__name__: f for f in (doc_tokens, normalized_text, doc_keywords, keyword_overlap, lexical_rank, name_specificity, identifier_match, classify_first_match, intent_flags, query_expansion, alias_overlap, severity_counts, rule_score, anchor_score, code_expansion)}

_KW, _NAME_KW = t.keywords(QUESTION), t.keywords(NAME, ())
_STEMS = f"SELECT doc_id, {s.stems('text')} AS st FROM documents"
_OVERLAP = f"SELECT doc_id, round({s.overlap('st', _KW, ' '.join(_KW))}, 6) AS score FROM ({_STEMS})"
_OBJECTS = "SELECT DISTINCT config_id, object_type, object_name FROM nodes WHERE kind = 'metadata' AND object_name IS NOT NULL"
_SEVERITY = "CASE WHEN contains(v, 'error') THEN 'error' WHEN contains(v, 'warn') THEN 'warning' WHEN contains(v, 'info') THEN 'information' WHEN contains(v, 'hint') THEN 'hint' WHEN v <> '' THEN v ELSE 'unknown' END"
_ANCHORS = search.Question(ANCHOR_QUESTION).anchors


def _alias_sql(words: list[str]) -> str:
    rows = f"SELECT config_id, object_type, object_name, {s.stems('object_name')} AS f0, 0 AS h0 FROM ({_OBJECTS})"
    for i, w in enumerate(words):
        akin = f"x = {s.q(w)} OR ({len(w)} >= 5 AND length(x) >= 5 AND (starts_with(x, {s.q(w)}) OR starts_with({s.q(w)}, x)))"
        rows = f"SELECT *, coalesce(list_position(list_transform(f{i}, lambda x: {akin}), true), 0) AS p{i} FROM ({rows})"
        rows = f"SELECT config_id, object_type, object_name, CASE WHEN p{i} > 0 THEN list_concat(f{i}[1:p{i} - 1], f{i}[p{i} + 1:]) ELSE f{i} END AS f{i + 1}, h{i} + (p{i} > 0)::INT AS h{i + 1} FROM ({rows})"
    return f"SELECT config_id, object_type, object_name, h{len(words)} AS hits FROM ({rows})"


def signals_sql(question: str) -> str:
    """F8 over na, nb, nc (the normalized name, path and text) and every (all three)."""
    q, out = t.normalize(question), []
    has = lambda col, phrases: "(" + " OR ".join(f"contains({col}, {s.q(p)})" for p in phrases) + ")"
    for _, where, phrases, weight, asked, otherwise in VALIDATION_SIGNALS:
        if asked in q:
            out.append(f"CASE WHEN {has({'method': 'na', 'document': 'nc', 'any': 'every'}[where], phrases)} THEN {weight}::DOUBLE ELSE {otherwise} END")
    kinds = "".join(f" WHEN {'module_type IN (' + ', '.join(map(s.q, types)) + ')' if types else f'starts_with(nb, {s.q(begins)})'} THEN {weight}::DOUBLE" for types, begins, weight in VALIDATION_MODULES)
    return " + ".join([*out, f"CASE{kinds} ELSE 0 END"])


SQL: dict[str, str] = {
    "doc_tokens": f"SELECT doc_id, len(n) AS tokens, len(list_distinct(n)) AS distinct_tokens FROM (SELECT doc_id, {s.tokens('text')} AS n FROM documents)",
    "normalized_text": f"SELECT doc_id, md5({s.normalized('text')}) AS normalized_md5 FROM documents",
    "doc_keywords": f"SELECT doc_id, array_to_string({s.keywords_of('st')}, ' ') AS keywords FROM ({_STEMS})",
    "keyword_overlap": _OVERLAP,
    "lexical_rank": f"SELECT * FROM ({_OVERLAP}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "name_specificity": f"SELECT config_id, object_type, object_name, round({s.specificity('st', _NAME_KW, ' '.join(_NAME_KW))}, 6) AS score FROM (SELECT *, {s.stems('object_name')} AS st FROM ({_OBJECTS}))",
    "identifier_match": f"SELECT config_id, object_type, object_name, round({s.identifier('n', 'st', NAME)}, 6) AS score FROM (SELECT *, {s.normalized('object_name')} AS n, {s.stems('object_name')} AS st FROM ({_OBJECTS}))",
    "classify_first_match": f"SELECT doc_id, {s.object_type('n')} AS object_type FROM (SELECT doc_id, {s.normalized('text')} AS n FROM documents)",
    "intent_flags": f"""WITH a AS (SELECT doc_id, {s.normalized('text')} AS n, {s.stems('text')} AS st FROM documents), b AS (SELECT doc_id, n, {s.keywords_of('st')} AS k, {s.keywords_of('st', CODE_STOPWORDS)} AS c FROM a)
SELECT doc_id, {s.any_in('n', STRUCTURE_PHRASES)} AS structural, {s.any_in('n', REPORT_PHRASES)} AS report, {s.akin_count('c', VALIDATION_PREFIXES)} >= 2 AS validation, {s.akin_count('k', REGISTER_PREFIXES)} > 0 AS register,
{s.any_in('n', STRUCTURE_PHRASES)} OR len(k) >= 2 AS navigation FROM b""",
    "query_expansion": f"""SELECT item_id, array_to_string(k, ' ') AS phrase, array_to_string(k, '') AS compact, array_to_string(k[1:8], ' ') AS short_phrase
FROM (SELECT item_id, {s.keywords_of('st')} AS k FROM (SELECT item_id, {s.stems('text')} AS st FROM eval_items))""",
    "severity_counts": f"SELECT {_SEVERITY} AS severity, count(*) AS findings FROM (SELECT lower(trim(coalesce(severity, ''))) AS v FROM (SELECT DISTINCT * FROM diagnostics)) GROUP BY ALL",
    "rule_score": f"SELECT DISTINCT id, method_name, module_path, round({signals_sql(CHECK_QUESTION)}, 6) AS score FROM (SELECT *, concat_ws(' ', na, nb, nc) AS every FROM (SELECT id, method_name, module_path, module_type, {s.normalized('method_name')} AS na, {s.normalized('module_path')} AS nb, {s.normalized('document')} AS nc FROM chunks WHERE chunk_type = 'code'))",
    "anchor_score": f"""SELECT config_id, object_type, object_name, synonym, round(CASE WHEN t = '' THEN 0 ELSE n * 0.7::DOUBLE + CASE WHEN n >= 2 THEN 1.2 ELSE 0 END - CASE WHEN n = 0 THEN least(1.4, {len(_ANCHORS)} * 0.35) ELSE 0 END + CASE WHEN contains(t, 'договор') THEN 2.2 WHEN contains(t, 'контрагент') THEN -1.2 ELSE 0 END END, 6) AS score
FROM (SELECT *, {' + '.join(f'contains(t, {s.q(a)})::INT' for a in _ANCHORS)} AS n FROM (SELECT *, array_to_string(list_concat({s.stems('object_name')}, {s.stems('synonym')}), ' ') AS t FROM (SELECT DISTINCT config_id, object_type, object_name, synonym FROM chunks WHERE chunk_type = 'metadata')))""",
    "alias_overlap": _alias_sql(t.keywords("журналы рецептура плановых складов")),
}
