"""Queries over exports and chunks: scans, identities from paths, parsers, state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metascope.functions.constants import ANNOTATIONS, CALL_KEYWORDS, FOLDERS, NAMESPACES, REFERENCE, REFERENCE_TYPES
from metascope.functions.text import severity_col
from metascope.operators.ledger import newest_versions
from metascope.plans import sql_text as s
from metascope.sources import descriptors, exports, modules
from metascope.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of each file, with its content: versions are picked without contents, by file_id."""
    f = table(spark, d, "export_files")
    new = newest_versions(f).select("file_id")
    return f.join(new, "file_id", "left_semi").dropDuplicates(["file_id"])


def export_scan(spark: SparkSession, d: str) -> DataFrame:
    return exports.indexable(table(spark, d, "export_files").select("config_id", "file_path", "rel_path", "file_id")).select("file_id").distinct()


def export_counts(spark: SparkSession, d: str) -> DataFrame:
    return exports.export_counts(table(spark, d, "export_files"), table(spark, d, "index_state"))


def schema_gate(spark: SparkSession, d: str) -> DataFrame:
    return exports.schema_gate(table(spark, d, "index_state"), table(spark, d, "configs"))


def incremental_changes(spark: SparkSession, d: str) -> DataFrame:
    """S2 alone: the newest version against the last state row, whoever wrote it."""
    st = table(spark, d, "index_state").select("config_id", exports.slashes(F.col("rel_path")).alias("rel_path"), F.struct("written_at", "state_id", "mtime").alias("v"))
    last = st.groupBy("config_id", "rel_path").agg(F.max("v").alias("v")).select("config_id", "rel_path", "v.mtime")
    return exports.changed_files(newest_versions(table(spark, d, "export_files")), last).select("config_id", "rel_path", "file_id", "mtime")


def form_identity(spark: SparkSession, d: str) -> DataFrame:
    rel = F.col("rel_path")
    return table(spark, d, "export_files").select("config_id", "rel_path").distinct().filter(exports.is_form_xml(rel)).select("config_id", "rel_path", exports.form_identity(rel).alias("i")).select("config_id", "rel_path", "i.*")


def module_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "export_files").filter(F.lower("rel_path").endswith(".bsl")).select("config_id", "rel_path").distinct().select("config_id", "rel_path", exports.module_identity(F.col("rel_path")).alias("i")).select("config_id", "rel_path", "i.*")


def line_snippet(spark: SparkSession, d: str) -> DataFrame:
    return exports.line_snippet(table(spark, d, "chunks").filter("chunk_type = 'code'").select("id", "document").distinct(), "id", "document", 2, 4)


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", "chunk_type").distinct().groupBy("chunk_type").agg(F.count(F.lit(1)).alias("chunks"))


def point_scan(spark: SparkSession, d: str) -> DataFrame:
    """The payload of chunks of a type, without texts."""
    return table(spark, d, "chunks").filter("chunk_type = 'metadata_form' and config_id is not null").select("id", "config_id", "form_name", "owner_name", "file_path").distinct()


def metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("chunk_type = 'metadata' and object_type = 'Catalog'").select("id", "config_id", "object_type", "object_name", "synonym").distinct()


def form_scan(spark: SparkSession, d: str) -> DataFrame:
    """Form chunks; for configurations without any, their form nodes."""
    chunks = table(spark, d, "chunks").filter("chunk_type = 'metadata_form'").select("config_id", "form_name", "owner_name", F.lit("chunk").alias("origin")).distinct()
    nodes = table(spark, d, "nodes").filter("kind = 'form'").select("config_id", "form_name", "owner_name", F.lit("node").alias("origin")).distinct()
    return chunks.unionByName(nodes.join(chunks.select("config_id").distinct(), "config_id", "left_anti"))


def code_signatures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("chunk_type = 'code' and method_name <> ''").select("config_id", "file_path", "module_path", "module_type", "method_name", "start_line", "end_line").distinct()


def module_scan(spark: SparkSession, d: str) -> DataFrame:
    """Module nodes with their summary's attributes laid over."""
    n = table(spark, d, "nodes").filter("kind = 'module' and module_path is not null").groupBy("config_id", "module_path").agg(F.max("module_type").alias("module_type"), F.max("file_path").alias("file_path"))
    c = table(spark, d, "chunks").filter("chunk_type = 'code_module_summary' and module_path is not null").groupBy("config_id", "module_path").agg(F.max("module_type").alias("t"), F.max("file_path").alias("f"), F.max("method_count").alias("method_count"))
    return n.join(c, ["config_id", "module_path"], "left").select("config_id", "module_path", F.coalesce("t", "module_type").alias("module_type"), F.coalesce("f", "file_path").alias("file_path"), "method_count")


def code_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each module and method the code chunk that is found first: the least line, then the least id. One
    aggregation instead of a lookup for each row."""
    c = table(spark, d, "chunks").filter("chunk_type = 'code' and method_name is not null and module_path is not null")
    return c.groupBy("config_id", "module_path", "method_name").agg(F.min(F.struct(F.coalesce("start_line", F.lit(2147483647)).alias("l"), "id")).alias("v")).select("config_id", "module_path", "method_name", "v.id")


def _code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("chunk_type = 'code' and document is not null").select("id", "document").distinct()


def call_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d).select("id", F.explode(modules.call_candidates(F.col("document"))).alias("c")).select("id", "c.*")


def metadata_usages(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d).select("id", F.explode(modules.metadata_usages(F.col("document"))).alias("u")).select("id", "u.*")


def type_references(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").filter("document is not null").select("id", F.concat_ws(" ", "document", F.array_join("sources", " ")).alias("x")).distinct()
    return c.select("id", F.posexplode(modules.type_references(F.col("x"))).alias("place", "r")).select("id", "place", "r.*")


def _annotation_pattern() -> str:
    return rf"(?iu)&({'|'.join(sorted(ANNOTATIONS, key=len, reverse=True))})\s*\(\s*[\"']([^\"']+)[\"']\s*\)"


def extension_annotations(spark: SparkSession, d: str) -> DataFrame:
    """X2 over the texts of documents: kind and target of the first annotation of each text that has one. annotation_places
    has them all."""
    pattern = _annotation_pattern()
    kinds = F.create_map(*[F.lit(x) for kv in ANNOTATIONS.items() for x in kv])
    d_ = table(spark, d, "documents").filter("text is not null").select("doc_id", F.regexp_extract("text", pattern, 1).alias("k"), F.regexp_extract("text", pattern, 2).alias("target_method"))
    return d_.filter("k <> ''").select("doc_id", kinds[F.lower("k")].alias("annotation"), F.trim("target_method").alias("target_method"))


def annotation_places(spark: SparkSession, d: str) -> DataFrame:
    """X2 over the texts of documents: kind and target of every annotation, with its place in the text from 0."""
    pattern = _annotation_pattern()
    kinds = F.create_map(*[F.lit(x) for kv in ANNOTATIONS.items() for x in kv])
    d_ = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("place", "m"))
    return d_.select("doc_id", "place", kinds[F.lower(F.regexp_extract("m", pattern, 1))].alias("annotation"), F.trim(F.regexp_extract("m", pattern, 2)).alias("target_method"))


def module_summary(spark: SparkSession, d: str) -> DataFrame:
    m = code_signatures(spark, d).filter("module_path is not null and start_line is not null")
    return modules.module_summaries(m).select("config_id", "module_path", "module_type", "method_count", F.md5(F.col("document").cast("binary")).alias("document_md5"))


def method_chunks(spark: SparkSession, d: str) -> DataFrame:
    return modules.methods(_files(spark, d)).drop("body")


def object_cards(spark: SparkSession, d: str) -> DataFrame:
    return descriptors.objects(_files(spark, d)).select("config_id", "rel_path", "object_type", "object_name", "synonym", "document", F.size("refs").alias("refs"))


def form_cards(spark: SparkSession, d: str) -> DataFrame:
    return descriptors.forms(_files(spark, d)).select("config_id", "rel_path", "form_name", "owner_object_type", "owner_name", "root_type", "document", F.size("elements").alias("elements"), F.size("events").alias("events"), F.size("commands").alias("commands"))


def form_elements(spark: SparkSession, d: str) -> DataFrame:
    return descriptors.forms(_files(spark, d)).select("config_id", "rel_path", F.explode("elements").alias("e")).select("config_id", "rel_path", "e.element_id", "e.element_name", "e.element_type", "e.parent_element_id", "e.depth", F.size("e.events").alias("events"))


def event_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    return descriptors.subscriptions(_files(spark, d)).select("config_id", "rel_path", "subscription_name", "event", "handler_module", "handler_method", "sources")


def structure_issues(spark: SparkSession, d: str) -> DataFrame:
    return modules.validate_modules(_files(spark, d))


def card_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return modules.card_dependencies(descriptors.objects(_files(spark, d)).select(F.concat_ws(":", "config_id", "rel_path").alias("key"), "document"))


def sequence_validation(spark: SparkSession, d: str) -> DataFrame:
    """The window form of the balance check, over every code document's lines: openers and closers of conditions, depth at
    the end and closers too many. One window by document, whose lines are bounded by the document."""
    lines = _code(spark, d).select("id", F.posexplode(F.split("document", "\n")).alias("n", "l"))
    step = F.when(F.lower("l").rlike(r"^\s*(если|if)\s"), 1).when(F.lower("l").rlike(r"^\s*(конецесли|endif)\s*;"), -1).otherwise(0)
    run = lines.withColumn("sum", F.sum(step).over(Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("id").agg(F.max_by("sum", "n").alias("end_sum"), F.least(F.lit(0), F.min("sum")).alias("low")).select("id", (F.col("end_sum") - F.col("low")).cast("bigint").alias("open_conditions"), (-F.col("low")).cast("bigint").alias("extra_ends"))


def json_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Findings written as a report's JSON, one report for each file, read back as rows."""
    f = table(spark, d, "diagnostics").distinct().filter("file_path is not null")
    item = F.struct("severity", "code", "message", F.struct(F.struct((F.col("line_no") - 1).alias("line"), (F.col("col_no") - 1).alias("character")).alias("start")).alias("range"))
    reports = f.select(F.to_json(F.struct(F.array(F.struct(F.col("file_path").alias("path"), F.array(item).alias("diagnostics"))).alias("fileinfos"))).alias("report"))
    return modules.report_diagnostics(reports)


def index_status(spark: SparkSession, d: str) -> DataFrame:
    """Of each configuration, chunks by type, cached files and graph size."""
    c = table(spark, d, "chunks").select("id", "config_id", "chunk_type").distinct().groupBy("config_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_type") == "code").alias("code"), F.count_if(F.col("chunk_type").startswith("metadata")).alias("metadata"))
    st = table(spark, d, "index_state").groupBy("config_id").agg(F.countDistinct(exports.slashes(F.col("rel_path"))).alias("cached_files"))
    n = table(spark, d, "nodes").groupBy("config_id").agg(F.countDistinct("id").alias("nodes"))
    e = table(spark, d, "edges").groupBy("config_id").agg(F.countDistinct("seq").alias("edges"))
    out = table(spark, d, "configs").select("config_id").distinct()
    for part in (c, st, n, e):
        out = out.join(part, "config_id", "left")
    return out.na.fill(0)


def list_configurations(spark: SparkSession, d: str) -> DataFrame:
    """The registry, with the base's name where it is registered."""
    c = table(spark, d, "configs")
    base = c.select(F.col("config_id").alias("b"), F.col("config_name").alias("base_name"))
    return c.join(base, c.base_config_id == base.b, "left").select("config_id", "config_name", "config_kind", "config_profile", "platform_version", "base_config_id", "base_name", "is_default")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        export_scan, export_counts, schema_gate, incremental_changes, form_identity, module_identity, line_snippet, chunk_counts, point_scan, metadata_scan, form_scan, code_signatures, module_scan, code_lookup, call_candidates,
        metadata_usages, type_references, extension_annotations, annotation_places, module_summary, method_chunks, object_cards, form_cards, form_elements, event_subscriptions, structure_issues, card_dependencies, sequence_validation,
        json_diagnostics, index_status, list_configurations,
    )
}

_ANNOTATION = rf"(?i)&({'|'.join(sorted(ANNOTATIONS, key=len, reverse=True))})\s*\(\s*[\"']([^\"']+)[\"']\s*\)"
_REL = r"replace(rel_path, '\', '/')"
_NAME = "[A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_]*"
_BARE = r"""regexp_replace(regexp_replace(replace(document, chr(13), ''), '//[^\n]*', '', 'g'), '"(?:[^"\n]|"")*"', '""', 'g')"""
_FOLDER = "CASE {x} " + " ".join(f"WHEN {s.q(a)} THEN {s.q(b)}" for a, b in FOLDERS.items()) + " ELSE {x} END"
_CODE = "SELECT DISTINCT id, document FROM chunks WHERE chunk_type = 'code' AND document IS NOT NULL"
_FORM_XML = "(lower(rel) LIKE '%.xml' AND CASE WHEN at_ > 0 THEN n = at_ + 1 OR (n >= at_ + 3 AND p[-1] = 'Form.xml' AND p[-2] = 'Ext') ELSE n >= 4 AND p[1] = 'CommonForms' AND p[-1] = 'Form.xml' AND p[-2] = 'Ext' END)"
_SIGNATURES = "SELECT DISTINCT config_id, file_path, module_path, module_type, method_name, start_line, end_line FROM chunks WHERE chunk_type = 'code' AND method_name <> ''"
_KEYWORDS = "(" + ", ".join(s.q(k) for k in CALL_KEYWORDS) + ")"
_STEM = r"regexp_replace(p[-1], '\.[^.]*$', '')"
_PATHS = rf"SELECT DISTINCT config_id, rel_path, {_REL} AS rel, string_split({_REL}, '/') AS p, len(string_split({_REL}, '/')) AS n, coalesce(list_position(string_split({_REL}, '/'), 'Forms'), 0) AS at_ FROM export_files"

SQL: dict[str, str] = {
    "export_scan": rf"""WITH f AS (SELECT *, {_REL} AS rel FROM export_files), roots AS (SELECT DISTINCT config_id, regexp_replace(rel, '[^/]*$', '') AS root FROM f WHERE regexp_matches(rel, '(^|/)Configuration\.xml$') AND rel <> 'Configuration.xml')
SELECT DISTINCT file_id FROM f WHERE regexp_matches(lower(rel), '\.(bsl|xml)$') AND NOT regexp_matches(rel, '(^|/)(ConfigDumpInfo|Configuration)\.xml$') AND NOT regexp_matches(rel, '(^|/)\.git/')
AND NOT (lower(rel) LIKE '%.xml' AND regexp_matches(rel, '(^|/)Templates/')) AND NOT EXISTS (SELECT 1 FROM roots r WHERE r.config_id = f.config_id AND starts_with(f.rel, r.root))""",
    "export_counts": rf"""WITH f AS (SELECT config_id, {_REL} AS rel, max(mtime) AS mtime FROM export_files GROUP BY ALL), k AS (SELECT config_id, {_REL} AS rel, list(DISTINCT mtime) AS ms FROM index_state GROUP BY ALL),
g AS (SELECT f.*, k.ms, string_split(f.rel, '/') AS p, len(string_split(f.rel, '/')) AS n, coalesce(list_position(string_split(f.rel, '/'), 'Forms'), 0) AS at_ FROM f LEFT JOIN k USING (config_id, rel))
SELECT config_id, count(*) AS files, count(*) FILTER (lower(rel) LIKE '%.bsl') AS bsl, count(*) FILTER (lower(rel) LIKE '%.xml') AS xml, count(*) FILTER ({_FORM_XML}) AS form_xml, count(*) FILTER (ms IS NULL) AS unknown,
count(*) FILTER (ms IS NOT NULL AND NOT list_contains(ms, mtime)) AS changed FROM g GROUP BY ALL""",
    "schema_gate": """SELECT c.config_id, count(s.cache_file) AS cached, count(s.cache_file) FILTER (s.schema_version IS DISTINCT FROM 4) AS stale, count(s.cache_file) FILTER (s.schema_version IS DISTINCT FROM 4) > 0 AS rebuild
FROM (SELECT DISTINCT config_id, cache_file FROM configs WHERE config_id IS NOT NULL) c LEFT JOIN index_state s ON s.config_id = c.config_id AND s.cache_file = c.cache_file GROUP BY ALL""",
    "incremental_changes": rf"""WITH n AS (SELECT config_id, {_REL} AS rel_path, max(struct_pack(a := scanned_at, b := file_id, m := mtime)) AS v FROM export_files GROUP BY ALL),
l AS (SELECT config_id, {_REL} AS rel_path, max(struct_pack(a := written_at, b := state_id, m := mtime)) AS w FROM index_state GROUP BY ALL)
SELECT n.config_id, n.rel_path, v.b AS file_id, v.m AS mtime FROM n LEFT JOIN l USING (config_id, rel_path) WHERE w IS NULL OR v.m IS DISTINCT FROM w.m""",
    "form_identity": f"""SELECT config_id, rel_path, form_name, owner_type, {_FOLDER.format(x='owner_type')} AS owner_object_type, owner_name FROM (SELECT config_id, rel_path,
CASE WHEN at_ > 0 AND n > at_ THEN CASE WHEN lower(p[at_ + 1]) LIKE '%.xml' THEN regexp_replace(p[at_ + 1], '\\.[^.]*$', '') ELSE p[at_ + 1] END WHEN at_ = 0 AND n >= 2 AND p[1] = 'CommonForms' THEN p[2] ELSE {_STEM} END AS form_name,
CASE WHEN at_ >= 3 THEN p[at_ - 2] WHEN at_ = 2 THEN p[1] WHEN at_ = 0 AND n >= 2 THEN p[1] ELSE '' END AS owner_type, CASE WHEN at_ >= 3 THEN p[at_ - 1] WHEN at_ > 0 THEN '' WHEN n >= 2 THEN p[2] ELSE '' END AS owner_name
FROM ({_PATHS}) WHERE {_FORM_XML})""",
    "module_identity": f"""SELECT config_id, rel_path, module_type, module_name, CASE WHEN at_ > 0 AND n > at_ AND form THEN base || '.Forms.' || p[at_ + 1] || '.FormModule' WHEN n >= 5 AND module_type = 'CommonForms' AND form THEN base || '.FormModule'
WHEN contains(p[-1], 'ObjectModule.bsl') THEN base || '.МодульОбъекта' WHEN contains(p[-1], 'ManagerModule.bsl') THEN base || '.МодульМенеджера' ELSE base END AS module_path
FROM (SELECT *, module_type || '.' || module_name AS base, n >= 3 AND p[-3] = 'Ext' AND p[-2] = 'Form' AND p[-1] = 'Module.bsl' AS form FROM (SELECT *, p[1] AS module_type, CASE WHEN n >= 2 THEN p[2] ELSE {_STEM} END AS module_name FROM ({_PATHS}) WHERE lower(rel_path) LIKE '%.bsl'))""",
    "line_snippet": f"SELECT id, (i + 1)::INT AS line_no, l[i] AS line FROM (SELECT id, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT id, string_split(replace(replace(document, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[2:4] AS l FROM ({_CODE})))",
    "chunk_counts": "SELECT chunk_type, count(*) AS chunks FROM (SELECT DISTINCT id, chunk_type FROM chunks) GROUP BY ALL",
    "point_scan": "SELECT DISTINCT id, config_id, form_name, owner_name, file_path FROM chunks WHERE chunk_type = 'metadata_form' AND config_id IS NOT NULL",
    "metadata_scan": "SELECT DISTINCT id, config_id, object_type, object_name, synonym FROM chunks WHERE chunk_type = 'metadata' AND object_type = 'Catalog'",
    "form_scan": """WITH c AS (SELECT DISTINCT config_id, form_name, owner_name, 'chunk' AS origin FROM chunks WHERE chunk_type = 'metadata_form')
SELECT * FROM c UNION ALL SELECT DISTINCT config_id, form_name, owner_name, 'node' FROM nodes n WHERE kind = 'form' AND NOT EXISTS (SELECT 1 FROM c WHERE c.config_id = n.config_id)""",
    "code_signatures": _SIGNATURES,
    "module_scan": """WITH n AS (SELECT config_id, module_path, max(module_type) AS mt, max(file_path) AS fp FROM nodes WHERE kind = 'module' AND module_path IS NOT NULL GROUP BY ALL),
c AS (SELECT config_id, module_path, max(module_type) AS t, max(file_path) AS f, max(method_count) AS method_count FROM chunks WHERE chunk_type = 'code_module_summary' AND module_path IS NOT NULL GROUP BY ALL)
SELECT n.config_id, n.module_path, coalesce(t, mt) AS module_type, coalesce(f, fp) AS file_path, method_count FROM n LEFT JOIN c USING (config_id, module_path)""",
    "code_lookup": "SELECT config_id, module_path, method_name, id FROM chunks WHERE chunk_type = 'code' AND method_name IS NOT NULL AND module_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY config_id, module_path, method_name ORDER BY coalesce(start_line, 2147483647), id) = 1",
    "call_candidates": rf"""WITH c AS (SELECT id, {_BARE} AS code FROM ({_CODE})), q AS (SELECT id, unnest(regexp_extract_all(code, '(?:^|[^A-Za-zА-Яа-яЁё0-9_])({_NAME}\.{_NAME})\s*\(', 1)) AS x FROM c),
l AS (SELECT id, unnest(regexp_extract_all(code, '(?:^|[^A-Za-zА-Яа-яЁё0-9_.])({_NAME})\s*\(', 1)) AS m FROM c)
SELECT DISTINCT id, 'qualified' AS kind, split_part(x, '.', 1) AS module_name, split_part(x, '.', 2) AS method_name FROM q WHERE lower(split_part(x, '.', 1)) NOT IN {_KEYWORDS} AND lower(split_part(x, '.', 2)) NOT IN {_KEYWORDS}
UNION ALL SELECT DISTINCT id, 'local', '', m FROM l WHERE lower(m) NOT IN {_KEYWORDS}""",
    "metadata_usages": rf"""WITH u AS (SELECT id, unnest(regexp_extract_all({_BARE}, '(?:^|[^A-Za-zА-Яа-яЁё0-9_])((?:{'|'.join(sorted(NAMESPACES, key=len, reverse=True))})\.{_NAME})', 1)) AS x FROM ({_CODE}))
SELECT DISTINCT id, split_part(x, '.', 1) AS namespace, CASE split_part(x, '.', 1) {' '.join(f'WHEN {s.q(a)} THEN {s.q(b)}' for a, b in NAMESPACES.items())} END AS object_type, split_part(x, '.', 2) AS object_name FROM u""",
    "type_references": rf"""WITH c AS (SELECT DISTINCT id, concat_ws(' ', document, array_to_string(sources, ' ')) AS x FROM chunks WHERE document IS NOT NULL), r AS (SELECT id, regexp_extract_all(x, '{REFERENCE}') AS a FROM c)
SELECT id, (i - 1)::INT AS place, split_part(a[i], '.', 1) AS raw_type, CASE split_part(a[i], '.', 1) {' '.join(f'WHEN {s.q(a)} THEN {s.q(b)}' for a, b in REFERENCE_TYPES.items())} ELSE regexp_replace(split_part(a[i], '.', 1), 'Ref$', '') END AS target_type,
split_part(a[i], '.', 2) AS target_name FROM (SELECT id, a, unnest(range(1, len(a) + 1)) AS i FROM r)""",
    "extension_annotations": f"""SELECT doc_id, CASE lower(k) {' '.join(f'WHEN {s.q(a)} THEN {s.q(b)}' for a, b in ANNOTATIONS.items())} END AS annotation, trim(m) AS target_method FROM (SELECT doc_id, regexp_extract(text, {s.q(_ANNOTATION)}, 1) AS k, regexp_extract(text, {s.q(_ANNOTATION)}, 2) AS m FROM documents WHERE text IS NOT NULL) WHERE k <> ''""",
    "annotation_places": f"""SELECT doc_id, (i - 1)::INT AS place, CASE lower(ks[i]) {' '.join(f'WHEN {s.q(a)} THEN {s.q(b)}' for a, b in ANNOTATIONS.items())} END AS annotation, trim(ms[i]) AS target_method FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {s.q(_ANNOTATION)}, 1) AS ks, regexp_extract_all(text, {s.q(_ANNOTATION)}, 2) AS ms FROM documents WHERE text IS NOT NULL))""",
    "module_summary": rf"""SELECT config_id, module_path, module_type, n::INT AS method_count, md5('Модуль: ' || module_path || chr(10) || 'Тип модуля: ' || module_type || chr(10) || 'Количество методов: ' || n || chr(10) || 'Методы:' ||
array_to_string(list_transform(m[1:200], lambda x: chr(10) || '- ' || x.b), '') || CASE WHEN n > 200 THEN chr(10) || '- ... еще ' || (n - 200) || ' методов' ELSE '' END) AS document_md5
FROM (SELECT config_id, module_path, module_type, list_sort(list(struct_pack(a := start_line, b := method_name))) AS m, count(*) AS n FROM ({_SIGNATURES}) WHERE module_path IS NOT NULL AND start_line IS NOT NULL GROUP BY ALL)""",
    "sequence_validation": rf"""WITH l AS (SELECT id, unnest(range(1, len(a) + 1)) AS n, a FROM (SELECT id, string_split(document, chr(10)) AS a FROM ({_CODE}))),
s AS (SELECT id, n, CASE WHEN regexp_matches(lower(a[n]), '^\s*(если|if)\s') THEN 1 WHEN regexp_matches(lower(a[n]), '^\s*(конецесли|endif)\s*;') THEN -1 ELSE 0 END AS st FROM l),
r AS (SELECT id, n, sum(st) OVER (PARTITION BY id ORDER BY n) AS c FROM s)
SELECT id, (arg_max(c, n) - least(0, min(c)))::BIGINT AS open_conditions, (-least(0, min(c)))::BIGINT AS extra_ends FROM r GROUP BY id""",
    "json_diagnostics": f"""SELECT file_path AS file, coalesce(line_no - 1, 0) + 1 AS line, coalesce(col_no - 1, 0) + 1 AS "column", coalesce(nullif(code, ''), 'unknown') AS code,
CASE v WHEN '1' THEN 'error' WHEN '2' THEN 'warning' WHEN '3' THEN 'information' WHEN '4' THEN 'hint' ELSE CASE WHEN contains(v, 'error') THEN 'error' WHEN contains(v, 'warn') THEN 'warning' WHEN contains(v, 'info') THEN 'information' WHEN contains(v, 'hint') THEN 'hint' WHEN v <> '' THEN v ELSE 'unknown' END END AS severity,
trim(coalesce(message, '')) AS message FROM (SELECT DISTINCT *, lower(trim(coalesce(severity, ''))) AS v FROM diagnostics WHERE file_path IS NOT NULL)""",
    "index_status": rf"""SELECT c.config_id, coalesce(k.chunks, 0) AS chunks, coalesce(k.code, 0) AS code, coalesce(k.metadata, 0) AS metadata, coalesce(s.n, 0) AS cached_files, coalesce(n.n, 0) AS nodes, coalesce(e.n, 0) AS edges FROM (SELECT DISTINCT config_id FROM configs) c
LEFT JOIN (SELECT config_id, count(*) AS chunks, count(*) FILTER (chunk_type = 'code') AS code, count(*) FILTER (starts_with(chunk_type, 'metadata')) AS metadata FROM (SELECT DISTINCT id, config_id, chunk_type FROM chunks) GROUP BY ALL) k USING (config_id)
LEFT JOIN (SELECT config_id, count(DISTINCT {_REL}) AS n FROM index_state GROUP BY ALL) s USING (config_id) LEFT JOIN (SELECT config_id, count(DISTINCT id) AS n FROM nodes GROUP BY ALL) n USING (config_id) LEFT JOIN (SELECT config_id, count(DISTINCT seq) AS n FROM edges GROUP BY ALL) e USING (config_id)""",
    "list_configurations": "SELECT c.config_id, c.config_name, c.config_kind, c.config_profile, c.platform_version, c.base_config_id, b.config_name AS base_name, c.is_default FROM configs c LEFT JOIN configs b ON b.config_id = c.base_config_id",
}
