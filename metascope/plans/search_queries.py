"""Queries over vectors and rankings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metascope.operators import search, vectors
from metascope.plans import sql_text as s
from metascope.plans.text_queries import signals_sql
from metascope.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUESTION = "справочник журнал рецептур складов"
K = 10


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return _points(spark, d).filter(F.col("vec_id") % 50 == 0)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.topk(_points(spark, d), _queries(spark, d), K)


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vectors.topk(_points(spark, d).filter("label = 3"), _queries(spark, d), K)


def vector_multiquery_best(spark: SparkSession, d: str) -> DataFrame:
    """The vectors that are among the nearest of any query, with their best score and its query."""
    return vectors.best_per_key(vector_topk(spark, d))


def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return vectors.VectorIndex.fit(p).search(p, _queries(spark, d), K)


def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """The index against brute force."""
    return vectors.recall(vector_index_search(spark, d), vector_topk(spark, d))


def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document's embedding by hashed stems."""
    return vectors.embed(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "embedding")


def _objects(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").filter("chunk_type = 'metadata'").select("config_id", "file_path", "object_type", "object_name", "synonym", "document").distinct()
    return search.prepared(c, "object_name", "synonym", "document")


def object_lexical(spark: SparkSession, d: str) -> DataFrame:
    """F2: objects by words, all with a score above 0."""
    q = search.Question(QUESTION)
    return search.scored(_objects(spark, d), search.object_parts(q, "lexical")).filter("score > 0").select("config_id", "file_path", "object_type", "object_name", "score")


def object_lookup(spark: SparkSession, d: str) -> DataFrame:
    """objects by how like their name is to what is looked up, from 1 on."""
    rows = search.prepared(table(spark, d, "chunks").filter("chunk_type = 'metadata'").select("config_id", "object_type", "object_name", "synonym").distinct(), "object_name", "synonym")
    return search.scored(rows, search.object_lookup_parts("журнал рецептур")[:2]).filter("score >= 1")


def fusion_max(spark: SparkSession, d: str) -> DataFrame:
    """two rankings of objects fused by configuration and name."""
    a = object_lexical(spark, d).groupBy("config_id", "object_name").agg(F.max("score").alias("score"))
    b = object_lookup(spark, d).groupBy("config_id", "object_name").agg(F.max("score").alias("score"))
    f = vectors.fuse({"lexical": a, "lookup": b}, ["config_id", "object_name"])
    return f.select("config_id", "object_name", "score", "source", F.array_join("sources", "+").alias("sources"))


def explain_components(spark: SparkSession, d: str) -> DataFrame:
    """the parts of each object's score that count, as text."""
    q = search.Question(QUESTION)
    e = search.scored(_objects(spark, d), search.object_parts(q, "lexical"), explain=True)
    shown = F.array_join(F.transform("components", lambda p: F.concat(p["label"], F.lit("="), F.round(p["value"] * 100, 0).cast("bigint").cast("string"))), " ")
    return e.select("config_id", "file_path", "score", shown.alias("components"))


CODE_QUESTION = "проверить остатки по умолчанию"


def code_lexical(spark: SparkSession, d: str) -> DataFrame:
    """methods by words."""
    q = search.Question(CODE_QUESTION)
    c = table(spark, d, "chunks").filter("chunk_type = 'code'").select("id", "module_path", "module_type", "method_name", "document").distinct()
    return search.scored(search.prepared(c, "method_name", "module_path", "document"), search.code_parts(q, "lexical")).filter("score > 0").select("id", "method_name", "score")


QUERIES: dict[str, Query] = {f.__name__: f for f in (vector_topk, vector_topk_filtered, vector_multiquery_best, vector_index_search, vector_index_recall, embedded_documents, object_lexical, object_lookup, fusion_max, explain_components, code_lexical)}

_TOPK = """(SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 5) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, {points} p)"""
_PLACED = "SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS place FROM {rows} QUALIFY place <= 10"
_ALL = _PLACED.format(rows=_TOPK.format(points="embeddings"))
_Q = search.Question(QUESTION)
_OBJ = f"SELECT *, {s.stems('object_name')} AS a, {s.stems('synonym')} AS b, {s.stems('document')} AS c FROM (SELECT DISTINCT config_id, file_path, object_type, object_name, synonym, document FROM chunks WHERE chunk_type = 'metadata')"
_PRIMARY, _LOW, _REG = (", ".join(s.q(x) for x in xs) for xs in (search.PRIMARY_TYPES, search.LOW_SIGNAL_TYPES, search.REGISTER_TYPES))
_W = search.PROFILES["lexical"]


def _parts_sql() -> list[tuple[str, str]]:
    kw, ph = _Q.kw, _Q.phrase
    out = []
    for col, label, key in (("a", "name", "name"), ("b", "synonym", "synonym")):
        out += [(f"{label}_overlap", f"({s.overlap(col, kw, ph)}) * {_W[key][0]}::DOUBLE"), (f"{label}_specificity", f"({s.specificity(col, kw, ph)}) * {_W[key][1]}::DOUBLE")]
    out.append(("document_overlap", f"({s.overlap('c', kw, ph)}) * {_W['document']}::DOUBLE"))
    if _Q.kind:
        out.append(("type", f"CASE WHEN object_type = {s.q(_Q.kind)} THEN {_W['type'][0]}::DOUBLE ELSE {_W['type'][1]} END"))
    return out


_SUM = " + ".join(f"({v})" for _, v in _parts_sql())
_LEX = f"SELECT config_id, file_path, object_type, object_name, round({_SUM}, 6) AS score FROM ({_OBJ})"
_LOOK = f"""SELECT * FROM (SELECT config_id, object_type, object_name, synonym, round(1.8::DOUBLE * ({s.identifier('n', 'a', 'журнал рецептур')}) + 1.4::DOUBLE * ({s.identifier('m', 'b', 'журнал рецептур')}), 6) AS score
FROM (SELECT *, {s.normalized('object_name')} AS n, {s.stems('object_name')} AS a, {s.normalized('synonym')} AS m, {s.stems('synonym')} AS b FROM (SELECT DISTINCT config_id, object_type, object_name, synonym FROM chunks WHERE chunk_type = 'metadata'))) WHERE score >= 1"""
def _code_sql() -> str:
    q = search.Question(CODE_QUESTION)
    kw, ph = q.code_kw, q.code_phrase
    name, module = s.overlap("a", kw, ph), s.overlap("b", kw, ph)
    parts = [f"({name}) * 2.0::DOUBLE", f"({s.specificity('a', kw, ph)}) * 1.4::DOUBLE", f"({module}) * 2.4::DOUBLE", f"({s.specificity('b', kw, ph)}) * 1.4::DOUBLE"]
    parts += [f"CASE WHEN ({name}) + ({module}) < 0.25 THEN -99 ELSE 0 END", "CASE WHEN module_type = 'Reports' THEN -1.8 ELSE 0 END"]
    parts += [f"({signals_sql(CODE_QUESTION)})"] if q.validation else []
    stems = f"{s.stems('method_name')} AS a, {s.stems('module_path')} AS b, {s.normalized('method_name')} AS na, {s.normalized('module_path')} AS nb, {s.normalized('document')} AS nc"
    rows = f"SELECT *, concat_ws(' ', na, nb, nc) AS every FROM (SELECT *, {stems} FROM (SELECT DISTINCT id, module_path, module_type, method_name, document FROM chunks WHERE chunk_type = 'code'))"
    return f"SELECT id, method_name, round({' + '.join(f'({x})' for x in parts)}, 6) AS score FROM ({rows}) WHERE score > 0"


_SHOWN = " || ".join(f"CASE WHEN abs(v{i}) >= 0.05 THEN ' {n}=' || round(v{i} * 100, 0)::BIGINT ELSE '' END" for i, (n, _) in enumerate(_parts_sql()))

SQL: dict[str, str] = {
    "vector_topk": _ALL,
    "vector_topk_filtered": _PLACED.format(rows=_TOPK.format(points="(SELECT * FROM embeddings WHERE label = 3)")),
    "vector_multiquery_best": f"SELECT id, max(score) AS score, min(query_id) FILTER (score = m) AS query_id FROM (SELECT *, max(score) OVER (PARTITION BY id) AS m FROM ({_ALL})) GROUP BY id",
    "object_lexical": f"SELECT * FROM ({_LEX}) WHERE score > 0",
    "object_lookup": _LOOK,
    "code_lexical": _code_sql(),
    "fusion_max": f"""WITH a AS (SELECT config_id, object_name, max(score) AS x FROM ({_LEX}) WHERE score > 0 GROUP BY ALL), b AS (SELECT config_id, object_name, max(score) AS y FROM ({_LOOK}) GROUP BY ALL)
SELECT config_id, object_name, greatest(coalesce(x, y), coalesce(y, x)) AS score, CASE WHEN y IS NULL OR x >= y THEN 'lexical' ELSE 'lookup' END AS source, concat_ws('+', CASE WHEN x IS NOT NULL THEN 'lexical' END, CASE WHEN y IS NOT NULL THEN 'lookup' END) AS sources FROM a FULL JOIN b USING (config_id, object_name)""",
    "explain_components": f"SELECT config_id, file_path, round({' + '.join(f'v{i}' for i in range(len(_parts_sql())))}, 6) AS score, ltrim({_SHOWN}) AS components FROM (SELECT config_id, file_path, {', '.join(f'({v}) AS v{i}' for i, (_, v) in enumerate(_parts_sql()))} FROM ({_OBJ}))",
}
