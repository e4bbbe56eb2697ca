"""Queries over the graph: merging, neighbours, trees, impact, overlays, quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metascope.operators import graph, impact
from metascope.operators.ledger import newest_versions, pending_files, state_rows
from metascope.plans.export_queries import _files
from metascope.sources import descriptors, exports, modules
from metascope.plans.sql_ledger import LEDGER
from metascope.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
HOT = "metadata:Catalog.НоменклатураЕдиная"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").distinct()


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").distinct()


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(_nodes(spark, d).select("config_id", "id", "kind").distinct(), _edges(spark, d))


def node_merge(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_nodes(table(spark, d, "nodes").drop("recorded_at", "deleted_at"))


def edge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return graph.dedupe_edges(_edges(spark, d)).select("config_id", "seq", "from_id", "to_id", "edge_type", "raw_type")


def stub_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.stub_nodes(table(spark, d, "nodes"), table(spark, d, "edges"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """All neighbours of each node; a long list comes in several rows, each with the degree of the whole."""
    return graph.adjacency(_edges(spark, d)).drop("block")


def find_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.find_nodes(_nodes(spark, d), "metadata", 20, object_type="Catalog").select("node_seq", "config_id", "id", "object_name")


def node_by_id(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).filter(F.col("id") == HOT).select("node_seq", "config_id", "kind", "object_type", "object_name", "synonym")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return node_merge(spark, d)


def neighbors_out(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), _merged(spark, d), "outgoing").select("seq", "config_id", "from_id", "to_id", "edge_type", "n_kind", "n_name")


def neighbors_in(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), _merged(spark, d), "incoming", "handles_event").select("seq", "config_id", "to_id", "from_id", "event", "n_kind", "n_name")


def usages_by_type(spark: SparkSession, d: str) -> DataFrame:
    """How often each object is used, by kind of use and of user."""
    e = _edges(spark, d).filter(F.col("edge_type").isin("references_metadata", "uses_metadata") & F.col("to_id").isNotNull())
    return e.groupBy("config_id", "to_id", "edge_type", F.substring_index("from_id", ":", 1).alias("user_kind")).agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("from_id").alias("users"))


def callers(spark: SparkSession, d: str) -> DataFrame:
    """Each resolved call with both ends' methods."""
    return graph.neighbours(_edges(spark, d), _merged(spark, d), "incoming", "calls").select("seq", "config_id", "from_id", "to_id", "resolution", F.col("n_name").alias("caller"))


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Outgoing references, forms and modules of each object, counted."""
    e = _edges(spark, d).filter(F.col("edge_type").isin("references_metadata", "contains_form", "contains_module") & F.col("from_id").isNotNull())
    return e.groupBy("config_id", "from_id", "edge_type").agg(F.countDistinct("to_id").alias("targets"))


def object_context(spark: SparkSession, d: str) -> DataFrame:
    return impact.context(_edges(spark, d), 5)


def ordered_children(spark: SparkSession, d: str) -> DataFrame:
    return impact.ordered_children(_edges(spark, d), _nodes(spark, d))


def list_object_forms(spark: SparkSession, d: str) -> DataFrame:
    """The forms of each object."""
    e = graph.neighbours(_edges(spark, d), _merged(spark, d), "outgoing", "contains_form")
    return e.filter("n_kind is not null").select("config_id", "from_id", "to_id", "n_name").distinct()


def two_hop_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    return impact.two_hop_entrypoints(_edges(spark, d))


def impact_counts(spark: SparkSession, d: str) -> DataFrame:
    return impact.impact_counts(_edges(spark, d))


def impact_report(spark: SparkSession, d: str) -> DataFrame:
    """The methods of the files that a run would take, with what depends on them: a report of the 50 with most callers."""
    changed = pending_files(*[table(spark, d, x) for x in ("export_files", "index_state", "configs", "index_runs")]).select("config_id", "file_path").distinct()
    m = _nodes(spark, d).filter("kind = 'method' and file_path is not null").select("config_id", "id", "file_path").distinct().join(changed, ["config_id", "file_path"], "left_semi").select("config_id", "id").distinct()
    n = impact.impact_counts(_edges(spark, d), m)
    return m.join(n, ["config_id", "id"], "left").na.fill(0).orderBy(F.desc("callers"), F.desc("callees"), "config_id", "id").limit(50)


def unique_resolution(spark: SparkSession, d: str) -> DataFrame:
    """G7 over the method nodes: local calls by module and name that have exactly one other target."""
    m = _nodes(spark, d).filter("kind = 'method' and module_path is not null and method_name is not null").select("config_id", "module_path", "method_name", F.col("id").alias("target_id")).distinct()
    calls = _edges(spark, d).filter("edge_type = 'calls'").select("seq", "config_id", F.regexp_extract("from_id", r"^method:(.*)\.[^.]*$", 1).alias("module_path"), F.regexp_extract("to_id", r"\.([^.:]*):\d+$", 1).alias("method_name"), F.col("from_id").alias("source_id"))
    return graph.unique_resolution(calls, m, ["config_id", "module_path", "method_name"]).select("seq", "config_id", "source_id", "target_id")


def handler_links(spark: SparkSession, d: str) -> DataFrame:
    """Handlers with the method of their name in their form's own module; the last of equal names."""
    h = _nodes(spark, d).filter("kind = 'handler'").select("config_id", "id", "handler_name", "module_path").distinct()
    m = _nodes(spark, d).filter("kind = 'method'").groupBy("config_id", "module_path", F.col("method_name").alias("handler_name")).agg(F.max_by("id", F.struct("start_line", "id")).alias("method_id"))
    return h.join(m, ["config_id", "module_path", "handler_name"], "left").select("config_id", "id", "method_id")


def element_parents(spark: SparkSession, d: str) -> DataFrame:
    """Elements under the element that parent_element_id names, else under their form."""
    e = _merged(spark, d).filter("kind = 'form_element'").withColumn("form_id", F.regexp_extract("id", r"^form_element:(form:.*)\.[^.]*$", 1))
    p = e.select("config_id", "form_id", F.regexp_extract("id", r"\.([^.]*)$", 1).alias("parent_element_id"), F.col("id").alias("_up"))
    p = p.groupBy("config_id", "form_id", "parent_element_id").agg(F.min("_up").alias("_up"))
    return e.select("config_id", "form_id", "id", "parent_element_id").join(p, ["config_id", "form_id", "parent_element_id"], "left").select("config_id", "id", F.coalesce("_up", "form_id").alias("parent_id"))


def recursive_tree(spark: SparkSession, d: str) -> DataFrame:
    """All elements below each form's top elements, with their depth."""
    e = _edges(spark, d)
    top = e.filter("edge_type = 'contains_element' and to_id is not null").select("config_id", F.col("to_id").alias("id"))
    return graph.element_tree(e, top)


def form_hints(spark: SparkSession, d: str) -> DataFrame:
    return impact.form_hints(_nodes(spark, d), _edges(spark, d), elements=10, commands=3, events=5)


def overlay_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    return impact.overlay_report(impact.overlay(_merged(spark, d), table(spark, d, "configs")))


def overlay_reasons(spark: SparkSession, d: str) -> DataFrame:
    """W10's reasons: every extension method as if it were annotated with its own name."""
    n = _merged(spark, d).withColumn("extension_target_method", F.col("method_name")).withColumn("extension_annotation", F.lit("after"))
    return impact.overlay(n, table(spark, d, "configs"), ("method",)).groupBy("config_id", "in_base", "reason").agg(F.count(F.lit(1)).alias("methods"))


def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    """K7: the state with the rows of the newest files in place of their old ones."""
    st = table(spark, d, "index_state").select("config_id", exports.slashes(F.col("rel_path")).alias("rel_path"), "mtime").distinct()
    new = newest_versions(table(spark, d, "export_files")).select("config_id", "rel_path", "mtime")
    return impact.upsert(st, new, ["config_id", "rel_path"])


def freshness(spark: SparkSession, d: str) -> DataFrame:
    new = newest_versions(table(spark, d, "export_files")).select("config_id", "rel_path", "mtime")
    st = state_rows(table(spark, d, "index_state"), table(spark, d, "configs"), table(spark, d, "index_runs")).filter("run_status = 'success'").select("config_id", "rel_path", F.col("noted_mtime").alias("mtime"), "written_at")
    built = table(spark, d, "index_runs").filter("run_status = 'success'").select("config_id", F.col("finished_at").alias("built_at"))
    return impact.freshness(new, st, built)


def batch_validation(spark: SparkSession, d: str) -> DataFrame:
    return impact.batch_validation(table(spark, d, "export_files").select("config_id", "file_path"), table(spark, d, "diagnostics").distinct())


def post_change(spark: SparkSession, d: str) -> DataFrame:
    return impact.post_change_status(batch_validation(spark, d), impact_counts(spark, d), freshness(spark, d), newest_versions(table(spark, d, "export_files")))


def built_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph of the newest exported files, in numbers."""
    f = table(spark, d, "export_files")
    f = f.join(newest_versions(f).select("file_id"), "file_id", "left_semi")  # repeated rows give the same nodes and edges, which are merged
    n, e = graph.build_graph(descriptors.objects(f), descriptors.forms(f), modules.methods(f), modules.modules(f))
    return graph.graph_stats(n, e)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        graph_stats, node_merge, edge_dedupe, stub_nodes, adjacency, find_nodes, node_by_id, neighbors_out, neighbors_in, usages_by_type, callers, dependencies, object_context, ordered_children, list_object_forms,
        two_hop_entrypoints, impact_counts, impact_report, unique_resolution, handler_links, element_parents, recursive_tree, form_hints, overlay_semi_anti, overlay_reasons, upsert_by_key, freshness, batch_validation,
        post_change, built_graph,
    )
}

_ATTRS = [
    "file_path", "document", "object_type", "object_name", "synonym", "form_name", "owner_name", "module_type", "module_path", "method_name", "start_line", "end_line", "command_name", "handler_name", "event_name", "element_name",
    "element_type", "parent_element_id",
]
_LAST = ", ".join(f"arg_max({a}, node_seq) FILTER ({a} IS NOT NULL{'' if a.endswith('_line') else f' AND {a} <> {chr(39) * 2}'}) AS {a}" for a in _ATTRS)
_EVIDENCE = " OR ".join(f"coalesce({a}, '') <> ''" for a in graph.EVIDENCE if a != "root_type")
_MERGED = f"SELECT config_id, id, arg_max(kind, node_seq) AS kind, {_LAST}, NOT bool_or(({_EVIDENCE}) OR coalesce(NOT is_stub, false)) AS is_stub FROM nodes GROUP BY ALL"
_E = "e AS (SELECT DISTINCT * FROM edges)"
_NAME = "coalesce(object_name, form_name, module_path, method_name, command_name, handler_name, element_name)"
_KEY = ", ".join(f"coalesce({k}, '')" for k in graph.EDGE_KEY)
_NEAR = f"{_E}, m AS ({_MERGED}), x AS (SELECT config_id AS c, id AS i, kind AS n_kind, file_path AS n_file_path, {_NAME} AS n_name FROM m)"
_FORM = r"regexp_extract(id, '^[a-z_]+:(form:.*)\.[^.]*$', 1)"
_IMPACT = """p AS (SELECT config_id, to_id AS id, 'callers' AS part, from_id AS other FROM e WHERE edge_type = 'calls' UNION ALL SELECT config_id, from_id, 'callees', to_id FROM e WHERE edge_type = 'calls'
UNION ALL SELECT config_id, to_id, 'entrypoints', from_id FROM e WHERE edge_type = 'implements_handler'),
i AS (SELECT config_id, id, count(DISTINCT other) FILTER (part = 'callers') AS callers, count(DISTINCT other) FILTER (part = 'callees') AS callees, count(DISTINCT other) FILTER (part = 'entrypoints') AS entrypoints FROM p WHERE id IS NOT NULL AND other IS NOT NULL GROUP BY ALL)"""
_NEW = r"w AS (SELECT config_id, replace(rel_path, '\', '/') AS rel_path, max(struct_pack(a := scanned_at, b := file_id, m := mtime, f := file_path)) AS v FROM export_files GROUP BY ALL)"
_STATE = r"s AS (SELECT DISTINCT config_id, replace(rel_path, '\', '/') AS rel_path, mtime FROM index_state)"
_FRESH = f"""{LEDGER}, fr AS (SELECT n.config_id, n.rel_path, v.m IS DISTINCT FROM w.m AS stale, coalesce(v.m > b, false) AS newer_than_graph FROM newest n LEFT JOIN ok ON n.config_id = ok.config_id AND n.rel_path = ok.rel_path
LEFT JOIN (SELECT config_id, max(finished_at) AS b FROM index_runs WHERE run_status = 'success' GROUP BY ALL) g ON g.config_id = n.config_id)"""
_VALID = r"""d AS (SELECT lower(replace(file_path, '\', '/')) AS p, CASE WHEN contains(v, 'error') THEN 'error' WHEN contains(v, 'warn') THEN 'warning' ELSE 'other' END AS sv FROM (SELECT DISTINCT *, lower(trim(coalesce(severity, ''))) AS v FROM diagnostics)),
c AS (SELECT p, count(*) FILTER (sv = 'error') AS errors, count(*) FILTER (sv = 'warning') AS warnings, count(*) AS n FROM d GROUP BY ALL),
va AS (SELECT config_id, file_path, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(n - errors - warnings, 0) AS other, CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status
FROM (SELECT DISTINCT config_id, file_path FROM export_files) f LEFT JOIN c ON c.p = lower(replace(f.file_path, '\', '/')))"""
_OKEY = """CASE kind WHEN 'metadata' THEN CASE WHEN coalesce(file_path, '') <> '' THEN concat(coalesce(object_type, ''), chr(31), coalesce(object_name, '')) END WHEN 'form' THEN concat(chr(31), coalesce(owner_name, ''), chr(31), coalesce(form_name, ''))
WHEN 'module' THEN nullif(module_path, '') WHEN 'method' THEN concat(coalesce(module_path, ''), chr(31), coalesce(method_name, '')) WHEN 'command' THEN nullif(id, '') END"""
_OVERLAY = f"m AS ({_MERGED}), n AS (SELECT *, {_OKEY} AS k FROM m), x AS (SELECT n.*, c.base_config_id AS b, EXISTS (SELECT 1 FROM n q WHERE q.config_id = c.base_config_id AND q.kind = n.kind AND q.k = n.k) AS in_base FROM n JOIN (SELECT DISTINCT config_id, base_config_id FROM configs WHERE base_config_id IS NOT NULL) c USING (config_id) WHERE k IS NOT NULL)"

SQL: dict[str, str] = {
    "graph_stats": "SELECT config_id, 'node' AS part, kind AS name, count(*) AS n FROM (SELECT DISTINCT config_id, id, kind FROM nodes) GROUP BY ALL UNION ALL SELECT config_id, 'edge', edge_type, count(*) FROM (SELECT DISTINCT * FROM edges) GROUP BY ALL",
    "node_merge": _MERGED,
    "edge_dedupe": f"SELECT config_id, seq, from_id, to_id, edge_type, raw_type FROM (SELECT DISTINCT * FROM edges) QUALIFY row_number() OVER (PARTITION BY config_id, {_KEY} ORDER BY seq) = 1",
    "stub_nodes": "SELECT DISTINCT config_id, id, split_part(id, ':', 1) AS kind FROM (SELECT config_id, from_id AS id FROM edges UNION ALL SELECT config_id, to_id FROM edges) e WHERE id IS NOT NULL AND trim(id) <> '' AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.config_id = e.config_id AND n.id = e.id)",
    "adjacency": f"""WITH {_E}, p AS (SELECT config_id, from_id AS id, 'outgoing' AS direction, to_id AS other FROM e UNION ALL SELECT config_id, to_id, 'incoming', from_id FROM e)
SELECT config_id, id, direction, count(*) AS degree, CASE WHEN count(DISTINCT other) <= 200 THEN coalesce(array_to_string(list_sort(list(DISTINCT other)), '|'), '') END AS neighbours FROM p WHERE id IS NOT NULL GROUP BY ALL""",
    "find_nodes": "SELECT node_seq, config_id, id, object_name FROM (SELECT DISTINCT * FROM nodes) WHERE kind = 'metadata' AND object_type = 'Catalog' ORDER BY node_seq, id LIMIT 20",
    "node_by_id": f"SELECT DISTINCT node_seq, config_id, kind, object_type, object_name, synonym FROM nodes WHERE id = '{HOT}'",
    "neighbors_out": f"WITH {_NEAR} SELECT seq, config_id, from_id, to_id, edge_type, n_kind, n_name FROM e LEFT JOIN x ON c = config_id AND i = to_id",
    "neighbors_in": f"WITH {_NEAR} SELECT seq, config_id, to_id, from_id, event, n_kind, n_name FROM e LEFT JOIN x ON c = config_id AND i = from_id WHERE edge_type = 'handles_event'",
    "usages_by_type": f"WITH {_E} SELECT config_id, to_id, edge_type, split_part(from_id, ':', 1) AS user_kind, count(*) AS uses, count(DISTINCT from_id) AS users FROM e WHERE edge_type IN ('references_metadata', 'uses_metadata') AND to_id IS NOT NULL GROUP BY ALL",
    "callers": f"WITH {_NEAR} SELECT seq, config_id, from_id, to_id, resolution, n_name AS caller FROM e LEFT JOIN x ON c = config_id AND i = from_id WHERE edge_type = 'calls'",
    "dependencies": f"WITH {_E} SELECT config_id, from_id, edge_type, count(DISTINCT to_id) AS targets FROM e WHERE edge_type IN ('references_metadata', 'contains_form', 'contains_module') AND from_id IS NOT NULL GROUP BY ALL",
    "object_context": f"""WITH {_E}, s AS (SELECT config_id, from_id AS id, CASE edge_type WHEN 'references_metadata' THEN 'references' WHEN 'contains_form' THEN 'forms' WHEN 'contains_module' THEN 'modules' WHEN 'uses_metadata' THEN 'uses' END AS section, to_id AS other_id, seq FROM e
UNION ALL SELECT config_id, to_id, CASE edge_type WHEN 'references_metadata' THEN 'referenced_by' WHEN 'uses_metadata' THEN 'used_by' END, from_id, seq FROM e)
SELECT config_id, id, section, other_id, (row_number() OVER (PARTITION BY config_id, id, section ORDER BY seq, other_id))::INT AS place FROM s WHERE section IS NOT NULL AND id IS NOT NULL QUALIFY place <= 5""",
    "ordered_children": f"""WITH {_E}, k AS (SELECT config_id, id, min(start_line) AS start_line, max(method_name) AS method_name FROM nodes GROUP BY ALL), d AS (SELECT DISTINCT config_id, from_id AS parent_id, to_id AS id FROM e WHERE edge_type = 'declares_method')
SELECT config_id, parent_id, id, start_line, method_name, (row_number() OVER (PARTITION BY config_id, parent_id ORDER BY start_line NULLS LAST, method_name NULLS LAST, id))::INT AS place FROM d JOIN k USING (config_id, id) QUALIFY place <= 500""",
    "list_object_forms": f"WITH {_NEAR} SELECT DISTINCT config_id, from_id, to_id, n_name FROM e JOIN x ON c = config_id AND i = to_id WHERE edge_type = 'contains_form'",
    "two_hop_entrypoints": f"""WITH {_E}, r AS (SELECT config_id, to_id AS h, arg_min(from_id, seq) AS source_id FROM e WHERE edge_type IN ('handles_event', 'handled_by') GROUP BY ALL)
SELECT l.config_id, l.to_id AS method_id, l.from_id AS handler_id, r.source_id FROM (SELECT DISTINCT config_id, to_id, from_id FROM e WHERE edge_type = 'implements_handler') l LEFT JOIN r ON r.config_id = l.config_id AND r.h = l.from_id""",
    "impact_counts": f"WITH {_E}, {_IMPACT} SELECT * FROM i",
    "impact_report": f"""WITH {_E}, {_IMPACT}, {LEDGER}, k AS (SELECT DISTINCT config_id, file_path FROM work WHERE state = 'pending'),
t AS (SELECT DISTINCT n.config_id, n.id FROM nodes n JOIN k USING (config_id, file_path) WHERE n.kind = 'method')
SELECT config_id, id, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(entrypoints, 0) AS entrypoints FROM t LEFT JOIN i USING (config_id, id) ORDER BY callers DESC, callees DESC, config_id, id LIMIT 50""",
    "unique_resolution": rf"""WITH {_E}, m AS (SELECT DISTINCT config_id, module_path, method_name, id FROM nodes WHERE kind = 'method' AND module_path IS NOT NULL AND method_name IS NOT NULL),
c AS (SELECT seq, config_id, regexp_extract(from_id, '^method:(.*)\.[^.]*$', 1) AS module_path, regexp_extract(to_id, '\.([^.:]*):\d+$', 1) AS method_name, from_id AS source_id FROM e WHERE edge_type = 'calls')
SELECT seq, config_id, source_id, min(id) AS target_id FROM c JOIN m USING (config_id, module_path, method_name) WHERE id <> source_id GROUP BY seq, config_id, source_id HAVING count(*) = 1""",
    "handler_links": """WITH m AS (SELECT config_id, module_path, method_name, max(struct_pack(a := start_line, b := id)).b AS method_id FROM nodes WHERE kind = 'method' GROUP BY ALL)
SELECT h.config_id, h.id, m.method_id FROM (SELECT DISTINCT config_id, id, handler_name, module_path FROM nodes WHERE kind = 'handler') h LEFT JOIN m ON m.config_id = h.config_id AND m.module_path = h.module_path AND m.method_name = h.handler_name""",
    "element_parents": rf"""WITH e AS (SELECT config_id, id, parent_element_id, regexp_extract(id, '^form_element:(form:.*)\.[^.]*$', 1) AS f, regexp_extract(id, '\.([^.]*)$', 1) AS element_id FROM ({_MERGED}) WHERE kind = 'form_element'),
p AS (SELECT config_id, f, element_id, min(id) AS up FROM e GROUP BY ALL)
SELECT e.config_id, e.id, coalesce(p.up, e.f) AS parent_id FROM e LEFT JOIN p ON p.config_id = e.config_id AND p.f = e.f AND p.element_id = e.parent_element_id""",
    "recursive_tree": """WITH RECURSIVE s AS (SELECT DISTINCT config_id, from_id, to_id FROM edges WHERE edge_type = 'contains_child_element' AND from_id IS NOT NULL AND to_id IS NOT NULL),
t AS (SELECT DISTINCT config_id, to_id AS root_id, to_id AS id, 0 AS depth FROM edges WHERE edge_type = 'contains_element' AND to_id IS NOT NULL UNION SELECT t.config_id, t.root_id, s.to_id, t.depth + 1 FROM t JOIN s ON s.config_id = t.config_id AND s.from_id = t.id WHERE t.depth < 60)
SELECT config_id, root_id, id, min(depth)::INT AS depth FROM t GROUP BY ALL""",
    "form_hints": f"""WITH {_E}, n AS (SELECT config_id, id, max(kind) AS kind, max(element_name) AS element_name, max(element_type) AS element_type, max(handler_name) AS handler_name, max(command_name) AS command_name FROM nodes WHERE id IS NOT NULL GROUP BY ALL),
p AS (SELECT *, {_FORM} AS form_id FROM n WHERE kind IN ('form_element', 'command', 'handler') AND {_FORM} <> ''),
f AS (SELECT n.config_id, n.id AS form_id, count(*) FILTER (p.kind = 'form_element') AS e, count(*) FILTER (p.kind = 'command') AS c, count(*) FILTER (p.kind = 'handler') AS h FROM n LEFT JOIN p ON p.config_id = n.config_id AND p.form_id = n.id WHERE n.kind = 'form' GROUP BY ALL)
SELECT config_id, form_id, 'no_commands' AS hint, NULL::VARCHAR AS name, 0::BIGINT AS n FROM f WHERE c = 0 UNION ALL SELECT config_id, form_id, 'no_elements', NULL, 0 FROM f WHERE e = 0 UNION ALL SELECT config_id, form_id, 'large_form', NULL, e FROM f WHERE e >= 10
UNION ALL SELECT config_id, form_id, 'many_commands', NULL, c FROM f WHERE c >= 3 UNION ALL SELECT config_id, form_id, 'many_events', NULL, h FROM f WHERE h >= 5
UNION ALL SELECT config_id, form_id, 'duplicate_name', element_name, count(*) FROM p WHERE kind = 'form_element' AND element_name <> '' GROUP BY config_id, form_id, element_name HAVING count(*) > 1
UNION ALL SELECT config_id, form_id, 'unresolved_handler', handler_name, 1 FROM p WHERE kind = 'handler' AND NOT EXISTS (SELECT 1 FROM e WHERE edge_type = 'implements_handler' AND e.config_id = p.config_id AND e.from_id = p.id)
UNION ALL SELECT config_id, form_id, 'passive_command', element_name, 1 FROM p WHERE kind = 'form_element' AND regexp_matches(lower(element_type), 'button|command') AND coalesce(command_name, '') = '' AND NOT EXISTS (SELECT 1 FROM e WHERE edge_type IN ('invokes_command', 'handles_event', 'contains_child_element') AND e.config_id = p.config_id AND e.from_id = p.id)""",
    "overlay_semi_anti": f"""WITH {_OVERLAY} SELECT config_id, b AS base_config_id, kind, count(*) AS extension_total, count(*) FILTER (in_base) AS overlaid, count(*) FILTER (NOT in_base) AS added, 0::BIGINT AS resolved_annotations, 0::BIGINT AS unresolved_annotations FROM x GROUP BY ALL""",
    "overlay_reasons": f"""WITH {_OVERLAY}, t AS (SELECT config_id AS b, method_name, count(DISTINCT id) AS n FROM m WHERE kind = 'method' AND method_name <> '' GROUP BY ALL)
SELECT config_id, in_base, CASE WHEN in_base THEN NULL WHEN coalesce(n, 0) = 0 THEN 'target_absent_in_base_graph' WHEN n = 1 THEN 'target_found_in_other_module' ELSE 'target_name_ambiguous_outside_expected_module' END AS reason, count(*) AS methods FROM x LEFT JOIN t USING (b, method_name) WHERE kind = 'method' GROUP BY ALL""",
    "upsert_by_key": f"WITH {_NEW}, {_STATE} SELECT config_id, rel_path, mtime FROM s WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.config_id = s.config_id AND w.rel_path = s.rel_path) UNION ALL SELECT config_id, rel_path, v.m FROM w",
    "freshness": f"WITH {_FRESH} SELECT * FROM fr",
    "batch_validation": f"WITH {_VALID} SELECT * FROM va",
    "post_change": f"""WITH {_E}, {_IMPACT}, {_FRESH}, {_VALID}, o AS (SELECT (SELECT count(*) FROM newest) AS files, (SELECT sum(errors)::BIGINT FROM va) AS errors, (SELECT sum(warnings)::BIGINT FROM va) AS warnings, (SELECT count(*) FROM fr WHERE stale) AS stale, (SELECT count(*) FROM fr WHERE newer_than_graph) AS newer, (SELECT sum(callers)::BIGINT FROM i) AS callers)
SELECT *, CASE WHEN files = 0 THEN 'no_files' WHEN errors > 0 THEN 'failed_validation' WHEN newer > 0 OR stale > 0 THEN 'needs_reindex' WHEN warnings > 0 THEN 'passed_with_warnings' ELSE 'ready_for_review' END AS status FROM o""",
}
