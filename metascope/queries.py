"""Queries over the test tables and the same in SQL: the training-data operators of the core."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metascope.operators import ledger, nested, orphans
from metascope.plans import export_queries, graph_queries, search_queries, sink_queries, sql_nested, text_queries, tool_queries
from metascope.plans.sql_ledger import LEDGER as _LEDGER
from metascope.runtime import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_edges(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "configs"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).filter(F.col("orphan_kind") == "direct").select("seq").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found_items(table(spark, d, "raw_records"))


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """All items with labels, as one table."""
    return nested.flatten_records(table(spark, d, "raw_records"))


def _p4_table(name: str) -> Query:
    """One of the related flat tables; a parse of the payloads makes all six."""
    return lambda spark, d: nested.record_tables(table(spark, d, "raw_records"))[name]


def _sources(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("export_files", "index_state", "configs", "index_runs")]


def _work(spark: SparkSession, d: str) -> DataFrame:
    """What a new run leases from a ledger that holds what the runs noted."""
    led, token = ledger.run_work(spark, scratch(spark, "ledger"), *_sources(spark, d))
    return led.leased(token)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _work(spark, d).select("file_id").distinct()


def p5_run(spark: SparkSession, d: str) -> DataFrame:
    """A run to its end: it leases what is to do, finishes it and finds nothing more to do; items by state."""
    led, token = ledger.run_work(spark, scratch(spark, "ledger"), *_sources(spark, d))
    led.complete(token)
    led.add(ledger.build_ledger(*_sources(spark, d)))
    led.lease(datetime(9999, 1, 1), timedelta(hours=1))
    return led.items().groupBy("config_id", "state").agg(F.count(F.lit(1)).alias("items"))


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return ledger.pending_files(*_sources(spark, d))


def p5_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Work items per configuration and state."""
    return ledger.build_ledger(*_sources(spark, d)).groupBy("config_id", "state").agg(F.count(F.lit(1)).alias("items"))


_BLANK = r"(chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160)||chr(65279))"
_DIRECT = rf"""
e AS (SELECT DISTINCT seq, config_id, nullif(lower(trim(from_id, {_BLANK})), '') AS from_key, nullif(lower(trim(to_id, {_BLANK})), '') AS to_key, edge_type, observed_at FROM edges),
n AS (SELECT DISTINCT config_id, nullif(lower(trim(id, {_BLANK})), '') AS k, recorded_at, coalesce(deleted_at, TIMESTAMP '9999-12-31 23:59:59') AS until FROM nodes WHERE is_stub IS NOT TRUE),
direct AS (SELECT e.* FROM e LEFT JOIN (SELECT DISTINCT config_id, base_config_id FROM configs) c USING (config_id)
  WHERE to_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.k = e.to_key AND n.config_id IN (e.config_id, c.base_config_id) AND n.recorded_at <= e.observed_at AND e.observed_at < n.until))
"""
QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_report, p4_found, p4_tables, p5_found, p5_run, p5_files, p5_ledger)}
QUERIES |= {f"p4_{name}": _p4_table(name) for name in nested.TABLES}
SQL: dict[str, str] = {
    "p1_found": f"WITH {_DIRECT} SELECT DISTINCT seq FROM direct",
    "p1_report": f"""WITH RECURSIVE {_DIRECT},
scope AS (SELECT config_id AS s, config_id AS c FROM edges WHERE config_id IS NOT NULL UNION SELECT config_id, base_config_id FROM configs WHERE config_id IS NOT NULL AND base_config_id IS NOT NULL),
own AS (SELECT DISTINCT s, seq, config_id, from_key, to_key, edge_type, observed_at FROM e JOIN scope ON c = config_id WHERE from_key IS NOT NULL AND to_key IS NOT NULL AND observed_at IS NOT NULL AND edge_type IN {orphans.OWNERSHIP}),
span AS (SELECT s, k, recorded_at AS a, until AS b FROM n JOIN scope ON c = config_id WHERE recorded_at < until),
judged AS (SELECT o.*, coalesce(bool_or(a <= observed_at AND observed_at < b), false) AS there, coalesce(max(b) FILTER (b <= observed_at), TIMESTAMP '0001-01-01') AS g0, coalesce(min(a) FILTER (a > observed_at), TIMESTAMP '9999-12-31 23:59:59') AS g1
  FROM own o LEFT JOIN span ON span.s = o.s AND k = from_key GROUP BY ALL),
first AS (SELECT * FROM judged WHERE NOT there),
hang AS (SELECT DISTINCT s, to_key AS k, g0, g1 FROM first UNION SELECT o.s, o.to_key, h.g0, h.g1 FROM own o JOIN hang h ON o.s = h.s AND o.from_key = h.k AND h.g0 <= o.observed_at AND o.observed_at < h.g1),
inh AS (SELECT seq FROM first WHERE s = config_id UNION SELECT o.seq FROM own o JOIN hang h ON o.s = h.s AND o.from_key = h.k AND h.g0 <= o.observed_at AND o.observed_at < h.g1 WHERE o.s = o.config_id),
every AS (SELECT edge_type, observed_at, 1 AS d, seq IN (SELECT seq FROM inh) AS both_ FROM direct UNION ALL SELECT edge_type, observed_at, 0, false FROM e WHERE seq IN (SELECT seq FROM inh) AND seq NOT IN (SELECT seq FROM direct))
SELECT edge_type, strftime(observed_at, '%Y-%m') AS month, CAST(sum(d) AS BIGINT) AS direct, CAST(sum(1 - d) AS BIGINT) AS inherited, CAST(count_if(both_) AS BIGINT) AS direct_and_inherited FROM every GROUP BY ALL""",
    "p4_found": sql_nested.FOUND_ITEMS,
    "p5_found": f"WITH {_LEDGER} SELECT DISTINCT file_id FROM work WHERE state = 'pending'",
    "p5_run": f"WITH {_LEDGER} SELECT config_id, 'done' AS state, count(*) AS items FROM work GROUP BY ALL",
    "p5_files": f"WITH {_LEDGER} SELECT config_id, rel_path, file_path, file_id, mtime FROM work WHERE state = 'pending'",
    "p5_ledger": f"WITH {_LEDGER} SELECT config_id, state, count(*) AS items FROM work GROUP BY ALL",
}

for _more in (text_queries, export_queries, graph_queries, search_queries, tool_queries, sink_queries):
    QUERIES |= _more.QUERIES
    SQL |= _more.SQL
