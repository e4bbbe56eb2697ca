"""Queries through the sinks, the registry and the smaller sources; what is written goes to the shared folder and is read back."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metascope import config
from metascope.functions import text as t
from metascope.operators import nested
from metascope.plans import graph_queries
from metascope.plans.engine import Engine
from metascope.runtime import scratch, table
from metascope.sources import descriptors, exports
from metascope.sources.sinks import TableStore, graph_writers, markdown, relation_name, setup_collection

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = "trade_cf"


def relation_names(spark: SparkSession, d: str) -> DataFrame:
    """K4."""
    return table(spark, d, "edges").select("edge_type", relation_name(F.col("edge_type")).alias("relation")).distinct()


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    mine = F.col("config_id") == CONFIG
    return graph_queries.node_merge(spark, d).filter(mine), table(spark, d, "edges").filter(mine).distinct()


def json_graph(spark: SparkSession, d: str) -> DataFrame:
    """K1: a configuration's graph as JSON, twice, and what can be read of it."""
    n, e = _graph(spark, d)
    store = TableStore(spark, scratch(spark, "json"))
    for write in graph_writers("json, json"):
        write(store, n, e, CONFIG)
    at = f"{store.folder}/json/{CONFIG}"
    kinds = spark.read.schema("id string, kind string").json(f"{at}/nodes").select(F.lit("node").alias("part"), F.col("kind").alias("name"))
    types = spark.read.schema("edge_type string").json(f"{at}/edges").select(F.lit("edge").alias("part"), F.col("edge_type").alias("name"))
    return kinds.unionByName(types).groupBy("part", "name").agg(F.count(F.lit(1)).alias("n"))


def stored_graph(spark: SparkSession, d: str) -> DataFrame:
    """K2, K3, K6: graphs in the table store, with and without documents; the statistics that lie beside them."""
    n, e = _graph(spark, d)
    store = TableStore(spark, scratch(spark, "graph"))
    for write in graph_writers("table; structural"):
        write(store, n, e, CONFIG)
    return store.read("projection_stats")


def replaced_files(spark: SparkSession, d: str) -> DataFrame:
    """K7: the code chunks of a store in which the files of one configuration were handled again and half of them have
    nothing any more: rows by file."""
    c = table(spark, d, "chunks").filter("chunk_type = 'code' and file_path is not null").select("config_id", "file_path", "id").distinct()
    store = TableStore(spark, scratch(spark, "chunks"))
    store.write("code", c)
    mine = c.filter(F.col("config_id") == CONFIG)
    store.replace_files("code", mine.filter(F.length("file_path") % 2 == 0), mine.select("config_id", "file_path"))
    return store.read("code").groupBy("config_id", "file_path").agg(F.count(F.lit(1)).alias("chunks"))


def reindexed_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods by file after two runs over one folder of a configuration."""
    e, store = Engine.open(spark, d, CONFIG), TableStore(spark, scratch(spark, "methods"))
    for _ in range(2):
        e.reindex_path(store, "Catalogs", rebuild_graph=False)
    return store.read("methods").groupBy("config_id", "file_path").agg(F.count(F.lit(1)).alias("methods"))


def collection(spark: SparkSession, d: str) -> DataFrame:
    """K8: whether the table of points was made, for the first time, again, and with vectors of another length."""
    store = TableStore(spark, scratch(spark, "points"))
    made = [setup_collection(spark, store, 8), setup_collection(spark, store, 8)]
    store.write("points", spark.createDataFrame([("a", CONFIG, "code", "f", [0.0] * 8, "x")], store.read("points").schema))
    made += [setup_collection(spark, store, 8), setup_collection(spark, store, 16)]
    return spark.createDataFrame(list(enumerate(made, 1)), "step int, made boolean")


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """K9: a result as lines of Markdown."""
    df = table(spark, d, "configs").select("config_id", "config_kind").distinct().orderBy("config_id")
    return spark.createDataFrame(list(enumerate(markdown(df, "Configurations").split("\n"), 1)), "line_no int, line string")


def command_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of the commands that the exporter's records nest."""
    items = nested.flatten_records(table(spark, d, "raw_records"))
    forms = items.filter("item_kind = 'form'").select("record_id", F.col("label").alias("parent_label"), F.col("item_key").alias("form_name"), "item_type")
    none = F.lit(None).cast("string")
    c = items.filter("item_kind = 'command'").groupBy("record_id", "parent_label").agg(F.sort_array(F.collect_list(F.struct(F.col("name"), F.col("handler").alias("action"), none.alias("title"), none.alias("tooltip")))).alias("commands"))
    owner = F.split_part("item_type", F.lit("."), F.lit(1))
    f = c.join(forms, ["record_id", "parent_label"]).select("commands", "form_name", F.col("record_id").cast("string").alias("file_path"), none.alias("config_id"), owner.alias("owner_type"), owner.alias("owner_object_type"), F.split_part("item_type", F.lit("."), F.lit(2)).alias("owner_name"))
    return descriptors.command_cards(f).select("file_path", "form_name", "command_name", "action", "document").distinct()


def modules_under(spark: SparkSession, d: str) -> DataFrame:
    """S16."""
    f = table(spark, d, "export_files").select("config_id", "rel_path", "file_path").distinct()
    return exports.modules_under(f, "Documents").select("config_id", "rel_path")


def _registry(spark: SparkSession, d: str) -> list[config.RuntimeConfig]:
    """The registered configurations as a registry's text would name them."""
    rows = table(spark, d, "configs").select("config_id", "config_name", "export_path", "base_config_id", "is_default").distinct().orderBy("config_id").collect()  # the registry
    return config.registered(json.dumps({"configs": [{k: v for k, v in r.asDict().items() if v is not None} | {"default": bool(r["is_default"])} for r in rows]}), "/exports")


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Configurations read from a registry."""
    return config.config_table(spark, _registry(spark, d)).select("config_id", "base_config_id", "config_kind", "is_default")


def resolved_configuration(spark: SparkSession, d: str) -> DataFrame:
    """What is active by request, by settings, and by default, and what an engine switches to."""
    known = _registry(spark, d)
    asked = [("requested", config.resolve(known, {}, "Plant_CF").config_id), ("settings", config.resolve(known, {"CONFIG_ID": "fleet_cf"}).config_id), ("switched", Engine.open(spark, d, CONFIG).for_config("ledger_cf").config_id)]
    return spark.createDataFrame(asked, "by string, config_id string")


def code_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each method lose a comment, and the length of what is left."""
    c = table(spark, d, "chunks").filter("chunk_type = 'code' and document is not null").select("id", "document").distinct()
    lines = c.select("id", "document", F.explode(F.split("document", "\n")).alias("line")).select("id", "line", F.inline(F.array(F.struct(t.uncomment_col(F.col("line")).alias("code")))))
    return lines.groupBy("id").agg(F.count_if(F.col("code") != F.col("line")).alias("commented"), F.sum(F.char_length("code")).alias("characters"))


def tool_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether a language server and vectors are there; vectors are made of the configuration's chunks."""
    e = Engine.open(spark, d, CONFIG)
    rows = [("server", str(e.bsl_ls_status({})["ready"]) if "ready" in e.bsl_ls_status({}) else "False"), ("vectors", str(e.embedding_status()["ready"])), ("vectors_made", str(e.with_vectors().embedding_status()["ready"]))]
    return spark.createDataFrame(rows, "tool string, ready string")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (relation_names, json_graph, stored_graph, replaced_files, reindexed_methods, collection, report_lines, command_cards, modules_under, registry, resolved_configuration, code_lines, tool_states)
}
_COUNTS = f"""SELECT 'node' AS part, kind AS name, count(*) AS n FROM ({graph_queries._MERGED}) WHERE config_id = '{CONFIG}' GROUP BY ALL
UNION ALL SELECT 'edge', edge_type, count(*) FROM (SELECT DISTINCT * FROM edges WHERE config_id = '{CONFIG}') GROUP BY ALL"""
SQL: dict[str, str] = {
    "relation_names": r"SELECT DISTINCT edge_type, coalesce(nullif(regexp_replace(upper(coalesce(edge_type, '')), '[^\p{L}\p{N}_]', '', 'g'), ''), 'RELATED_TO') AS relation FROM edges",
    "json_graph": _COUNTS,
    "stored_graph": f"SELECT '{CONFIG}' AS config_id, part, name, n FROM ({_COUNTS})",
    "replaced_files": f"""SELECT config_id, file_path, count(*) AS chunks FROM (SELECT DISTINCT config_id, file_path, id FROM chunks WHERE chunk_type = 'code' AND file_path IS NOT NULL)
WHERE config_id IS DISTINCT FROM '{CONFIG}' OR length(file_path) % 2 = 0 GROUP BY ALL""",
    "collection": "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true)) v(step, made)",
    "report_lines": """WITH c AS (SELECT DISTINCT config_id, config_kind FROM configs), l AS (SELECT 3 AS o, '' AS k, '| config_id | config_kind |' AS line UNION ALL SELECT 1, '', '## Configurations' UNION ALL SELECT 2, '', '' UNION ALL SELECT 4, '', '|-|-|'
UNION ALL SELECT 5, config_id, '| ' || coalesce(config_id, '') || ' | ' || coalesce(config_kind, '') || ' |' FROM c) SELECT (row_number() OVER (ORDER BY o, k))::INT AS line_no, line FROM l""",
    "modules_under": r"""SELECT DISTINCT config_id, rel_path FROM export_files WHERE lower(rel_path) LIKE '%.bsl' AND starts_with(replace(rel_path, '\', '/'), 'Documents/')""",
    "resolved_configuration": "SELECT * FROM (VALUES ('requested', 'plant_cf'), ('settings', 'fleet_cf'), ('switched', 'ledger_cf')) v(\"by\", config_id)",
}
