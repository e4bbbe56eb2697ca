"""Queries over the test tables and the same in SQL: the training-data operators on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metascope.llm import contamination, pii, splitting, syntax, tokenizer
from metascope.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    p = splitting.split_documents(table(spark, d, "chunks"))
    return p.filter((F.col("piece_no") == 1) & (F.col("n_pieces") > 1)).select("id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Repeated rows are made distinct by id and text before they are cut, so that pieces are not shuffled."""
    c = table(spark, d, "chunks").select("id", "module_path", "method_name", "document").withColumn("_h", F.xxhash64("document"))
    return splitting.split_documents(c.dropDuplicates(["id", "module_path", "method_name", "_h"]))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized item: whether all pieces keep the limit, whether each begins with the end of the one before, and the
    hash of the pieces without their overlaps, put together."""
    c = table(spark, d, "chunks").select("id", "document").distinct()
    n, k = splitting.LIMIT, splitting.OVERLAP
    rows = c.filter(F.char_length("document") > n).select("id", splitting.pieces(F.col("document")).alias("ps"))
    fits = F.forall("ps", lambda p: F.char_length(p["piece"]) <= n)
    shares = F.forall(F.sequence(F.lit(1), F.size("ps") - 1), lambda i: F.left(F.get("ps", i)["piece"], F.lit(k)) == F.right(F.get("ps", i - 1)["piece"], F.lit(k)))
    whole = F.array_join(F.transform("ps", lambda p, i: F.when(i == 0, p["piece"]).otherwise(F.substr(p["piece"], F.lit(k + 1)))), "")
    return rows.select("id", fits.alias("fits"), shares.alias("shares"), F.md5(whole.cast("binary")).alias("document_md5")).distinct()


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return syntax.parse_files(table(spark, d, "export_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).filter(~F.col("accepted")).select("file_id").distinct()


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    """Each invalid version with its first cause and all its errors."""
    return _parsed(spark, d).filter(~F.col("accepted")).dropDuplicates(["file_id"])


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(_parsed(spark, d))


def p3_reported(spark: SparkSession, d: str) -> DataFrame:
    """How the validator's findings agree with the parser."""
    return syntax.against_diagnostics(_parsed(spark, d), table(spark, d, "diagnostics"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.round_trip(table(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.exact_leaks(_leaks(spark, d))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """With the leaks of up to one changed word in a window."""
    return _leaks(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "documents")).select("doc_id", "pii_type", "start_pos").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_documents(table(spark, d, "documents"))


_GRAMS = "unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' '))) AS g"

QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_pieces, p2_checks, p3_found, p3_errors, p3_rates, p3_reported, p6_ids, p6_round_trip, p7_found, p7_leaks, p8_found, p8_redacted)}
SQL: dict[str, str] = {
    "p2_found": "SELECT DISTINCT id FROM chunks WHERE length(document) > 4000",
    "p2_checks": "SELECT DISTINCT id, true AS fits, true AS shares, md5(document) AS document_md5 FROM chunks WHERE length(document) > 4000",
    "p7_found": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM eval_items WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, {_GRAMS} FROM d) a JOIN (SELECT item_id, {_GRAMS} FROM i) b USING (g)""",
}
