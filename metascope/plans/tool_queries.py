"""Every tool of the engine as a query over the configuration with the most objects of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metascope.plans import export_queries, graph_queries
from metascope.plans import sql_text as s
from metascope.plans.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
ISSUES = "plant_cfe"  # its modules have issues
CONFIG, OBJECT, KIND, WORDS = "trade_cf", "НоменклатураЕдиная", "Catalog", "проверить остатки складов"


def _tool(call: Callable[[Engine], DataFrame]) -> Query:
    return lambda spark, d: call(Engine.open(spark, d, CONFIG))


def _near(call: Callable[[Engine], DataFrame]) -> Query:
    """With vectors of the configuration's chunks by the hashing embedder."""
    return lambda spark, d: call(Engine.open(spark, d, CONFIG).with_vectors())


def _owner(edge_type: str) -> str:
    """SQL: type and name of the object of CONFIG with the most edges of a type to others; ties by id."""
    return f"SELECT from_id FROM edges WHERE config_id = '{CONFIG}' AND edge_type = '{edge_type}' AND from_id LIKE 'metadata:%' GROUP BY from_id ORDER BY count(DISTINCT to_id) DESC, from_id LIMIT 1"


def _of_owner(edge_type: str, call: Callable[[Engine, str, str], DataFrame]) -> Query:
    """A tool asked about the object with the most edges of a type, so that there is an answer in tables of any size."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        best = spark.sql(_owner(edge_type).replace("edges", "{e}"), e=spark.read.parquet(f"{d}/edges.parquet")).first()
        kind, _, name = (best[0] if best else f"metadata:{KIND}.{OBJECT}").partition(":")[2].partition(".")
        return call(Engine.open(spark, d, CONFIG), name, kind)

    return run


def _flat(df: DataFrame) -> DataFrame:
    """Arrays of structs as text, so that any reader can compare the rows."""
    return df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))})


QUERIES: dict[str, Query] = {
    "tool_search_code": _near(lambda e: _flat(e.search_code(WORDS))),
    "tool_search_metadata": _near(lambda e: _flat(e.search_metadata("справочник " + OBJECT))),
    "tool_explain_search_result": _near(lambda e: _flat(e.explain_search_result(WORDS))),
    "tool_find_metadata_object": _tool(lambda e: e.find_metadata_object(OBJECT, KIND)),
    "tool_find_form": _tool(lambda e: e.find_form("ФормаСписка")),
    "tool_form_structure_report": _tool(lambda e: e.form_structure_report("ФормаСписка")),
    "tool_search_modules": _near(lambda e: e.search_modules("модуль объекта актов")),
    "tool_search_commands": _near(lambda e: e.search_commands("обновить строки")),
    "tool_search_event_subscriptions": _near(lambda e: _flat(e.search_event_subscriptions("BeforeWrite"))),
    "tool_find_module": _tool(lambda e: e.find_module("МодульМенеджера")),
    "tool_find_common_module": _tool(lambda e: e.find_common_module("Маршруты")),
    "tool_list_module_methods": _tool(lambda e: e.list_module_methods("МодульОбъекта")),
    "tool_list_object_forms": _of_owner("contains_form", lambda e, name, kind: e.list_object_forms(name, kind)),
    "tool_find_method": _near(lambda e: e.find_method("ПроверитьОстатки")),
    "tool_find_usages": _tool(lambda e: e.find_usages(OBJECT, KIND)),
    "tool_get_callers": _tool(lambda e: e.get_callers(_METHOD)),
    "tool_get_callees": _tool(lambda e: e.get_callees(_METHOD)),
    "tool_get_dependencies": _of_owner("references_metadata", lambda e, name, kind: e.get_dependencies(name, kind)),
    "tool_get_file_snippet": _tool(lambda e: e.get_file_snippet("ObjectModule.bsl", 1, 2)),
    "tool_change_impact_report": _tool(lambda e: e.change_impact_report(OBJECT, KIND)),
    "tool_build_implementation_context": _near(lambda e: e.build_implementation_context(WORDS)),
    "tool_analyze_task": _near(lambda e: e.analyze_task(WORDS)),
    "tool_trace_business_flow": _near(lambda e: e.trace_business_flow(WORDS)),
    "tool_extension_overlay_report": _tool(lambda e: e.extension_overlay_report()),
    "tool_list_configurations": _tool(lambda e: e.list_configurations()),
    "tool_validate_bsl": lambda spark, d: Engine.open(spark, d, ISSUES).validate_bsl(".bsl"),
    "tool_validate_changed_files": lambda spark, d: Engine.open(spark, d, ISSUES).validate_changed_files(),
    "tool_post_change_report": _tool(lambda e: e.post_change_report()),
    "tool_index_status": _tool(lambda e: e.index_status()),
}
_ID = f"metadata:{KIND}.{OBJECT}"
_NOW = graph_queries._NEAR.replace("FROM nodes GROUP BY ALL", "FROM nodes WHERE deleted_at IS NULL GROUP BY ALL")  # the tools see what is not deleted
_SECTIONS = graph_queries.SQL["object_context"].replace("place <= 5", "place <= 20")
_METHOD = "ПроверитьОстатки"
_BEST = f"""best AS (SELECT 'method:' || module_path || '.' || method_name || ':' || start_line AS id FROM (SELECT *, round(({s.identifier('n', 'st', _METHOD)}) * 2.2::DOUBLE + CASE WHEN lower(method_name) = {s.q(_METHOD.lower())} THEN 5 ELSE 0 END, 6) AS score
  FROM (SELECT *, {s.normalized('method_name')} AS n, {s.stems('method_name')} AS st FROM (SELECT DISTINCT id, module_path, method_name, start_line FROM chunks WHERE config_id = '{CONFIG}' AND chunk_type = 'code'))) WHERE score >= 1.4 ORDER BY score DESC, module_path, start_line, id LIMIT 1)"""


def _calls_sql(own: str, other: str) -> str:
    return f"""WITH {_NOW}, {_BEST} SELECT from_id, to_id, resolution, n_name, n_file_path, seq FROM e LEFT JOIN x ON c = config_id AND i = {other} WHERE config_id = '{CONFIG}' AND edge_type = 'calls' AND {own} IN (SELECT id FROM best) ORDER BY seq LIMIT 20"""


_NEWEST = r"FROM (SELECT * FROM export_files QUALIFY row_number() OVER (PARTITION BY config_id, replace(rel_path, '\', '/') ORDER BY scanned_at DESC, file_id DESC) = 1) GROUP BY ALL"
_COUNTED = export_queries.SQL["export_counts"].replace("FROM export_files GROUP BY ALL", _NEWEST)

SQL: dict[str, str] = {
    "tool_index_status": f"""WITH {_NOW} SELECT 'chunks' AS section, chunk_type AS name, count(*) AS n FROM (SELECT DISTINCT id, chunk_type FROM chunks WHERE config_id = '{CONFIG}') GROUP BY ALL
UNION ALL SELECT 'node', kind, count(*) FROM m WHERE config_id = '{CONFIG}' GROUP BY ALL UNION ALL SELECT 'edge', edge_type, count(*) FROM e WHERE config_id = '{CONFIG}' GROUP BY ALL
UNION ALL SELECT 'files', name, n FROM (UNPIVOT (SELECT * EXCLUDE config_id FROM ({_COUNTED}) WHERE config_id = '{CONFIG}') ON COLUMNS(*) INTO NAME name VALUE n)""",
    "tool_get_callers": _calls_sql("to_id", "from_id"),
    "tool_get_callees": _calls_sql("from_id", "to_id"),
    "tool_list_configurations": f"SELECT *, config_id = '{CONFIG}' AS active FROM (SELECT DISTINCT * FROM configs)",
    "tool_extension_overlay_report": f"SELECT * FROM ({graph_queries.SQL['overlay_semi_anti']}) WHERE config_id = '{CONFIG}' OR base_config_id = '{CONFIG}'",
    "tool_change_impact_report": f"SELECT section, other_id FROM ({_SECTIONS}) WHERE config_id = '{CONFIG}' AND id = '{_ID}'",
    "tool_find_usages": f"""WITH {_NOW} SELECT edge_type, from_id, to_id, section, edge_source, n_kind, n_name, seq FROM e LEFT JOIN x ON c = config_id AND i = from_id
WHERE config_id = '{CONFIG}' AND to_id = '{_ID}' AND edge_type IN ('references_metadata', 'uses_metadata') ORDER BY seq LIMIT 20""",
    "tool_get_dependencies": f"""WITH {graph_queries._E} SELECT edge_type, to_id, section, edge_source, 'graph' AS origin FROM e WHERE config_id = '{CONFIG}' AND from_id = ({_owner("references_metadata")}) AND edge_type IN ('references_metadata', 'contains_form', 'contains_module')""",
    "tool_list_object_forms": f"""WITH {_NOW} SELECT DISTINCT to_id, n_name AS form_name, n_file_path AS file_path FROM e LEFT JOIN x ON c = config_id AND i = to_id WHERE config_id = '{CONFIG}' AND from_id = ({_owner("contains_form")}) AND edge_type = 'contains_form'""",
}
