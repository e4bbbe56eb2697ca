"""Change impact, overlays between a base and its extension, upserts, freshness, form quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metascope.operators.skew import first_rows, hot_keys, salted_join

KINDS = ("metadata", "form", "module", "method", "command")


def two_hop_entrypoints(edges: DataFrame) -> DataFrame:
    """For each method the handlers it implements and the first thing that raises each: config_id, method_id,
    handler_id, source_id (least seq of the handles_event and handled_by edges into the handler; null without one)."""
    raised = edges.filter(F.col("edge_type").isin("handles_event", "handled_by")).groupBy("config_id", F.col("to_id").alias("handler_id")).agg(F.min_by("from_id", "seq").alias("source_id"))
    links = edges.filter(F.col("edge_type") == "implements_handler").select("config_id", F.col("to_id").alias("method_id"), F.col("from_id").alias("handler_id")).distinct()
    return links.join(raised, ["config_id", "handler_id"], "left").select("config_id", "method_id", "handler_id", "source_id")


def impact_counts(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """V6: distinct callers, callees and entry points of each method: config_id, id, callers, callees, entrypoints.
    Neighbours are made distinct before they are counted, each pair once, so that a hot node is counted in parts."""
    calls = edges.filter(F.col("edge_type") == "calls")
    pairs = calls.select("config_id", F.col("to_id").alias("id"), F.lit("callers").alias("part"), F.col("from_id").alias("other"))
    pairs = pairs.unionByName(calls.select("config_id", F.col("from_id").alias("id"), F.lit("callees").alias("part"), F.col("to_id").alias("other")))
    pairs = pairs.unionByName(edges.filter(F.col("edge_type") == "implements_handler").select("config_id", F.col("to_id").alias("id"), F.lit("entrypoints").alias("part"), F.col("from_id").alias("other")))
    pairs = pairs.filter("id is not null and other is not null")
    if ids is not None:
        pairs = pairs.join(ids.select("config_id", "id").distinct(), ["config_id", "id"], "left_semi")
    n = pairs.distinct().groupBy("config_id", "id", "part").count()
    of = lambda p: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("count"))), F.lit(0)).alias(p)
    return n.groupBy("config_id", "id").agg(of("callers"), of("callees"), of("entrypoints"))


def overlay_key(kind: str) -> Column:
    """What a node of a kind is compared by; null for nodes that aren't compared."""
    target = F.coalesce(F.nullif(F.col("extension_target_method"), F.lit("")), F.col("method_name"))
    text = lambda *cs: F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in cs])
    if kind == "metadata":
        return F.when(F.coalesce("file_path", F.lit("")) != "", text(F.col("object_type"), F.col("object_name")))
    if kind == "form":
        return text(F.coalesce(F.nullif(F.col("owner_object_type"), F.lit("")), F.col("owner_type")), F.col("owner_name"), F.col("form_name"))
    if kind == "module":
        return F.nullif(F.col("module_path"), F.lit(""))
    if kind == "method":
        return text(F.col("module_path"), target)
    return F.nullif(F.col("id"), F.lit(""))


_OVERLAY_COLUMNS = ("file_path", "object_type", "object_name", "owner_object_type", "owner_type", "owner_name", "form_name", "module_path", "method_name", "extension_target_method", "extension_annotation")


def overlay(nodes: DataFrame, configs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Every extension node against its base configuration: config_id, base_config_id, kind, id, overlay_key,
    in_base, annotation, reason. in_base by a semi-join on the key; an annotated method that isn't in the base has the
    reason by how many base methods bear the target's name: none, one (in another module), or more."""
    for c in _OVERLAY_COLUMNS:
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast("string"))
    key = None
    for kind in kinds:
        key = F.when(F.col("kind") == kind, overlay_key(kind)) if key is None else key.when(F.col("kind") == kind, overlay_key(kind))
    n = nodes.filter(F.col("kind").isin(*kinds)).withColumn("overlay_key", key).filter("overlay_key is not null")
    ext = configs.filter("base_config_id is not null").select("config_id", "base_config_id").distinct()
    e = n.join(ext, "config_id").select("config_id", "base_config_id", "kind", "id", "overlay_key", F.nullif(F.col("extension_annotation"), F.lit("")).alias("annotation"), "extension_target_method")
    base = n.select(F.col("config_id").alias("base_config_id"), "kind", "overlay_key").distinct().withColumn("in_base", F.lit(True))
    names = n.filter("kind = 'method' and method_name <> ''").groupBy(F.col("config_id").alias("base_config_id"), F.col("method_name").alias("extension_target_method")).agg(F.countDistinct("id").alias("_n"))
    j = e.join(base, ["base_config_id", "kind", "overlay_key"], "left").withColumn("in_base", F.coalesce("in_base", F.lit(False))).join(names, ["base_config_id", "extension_target_method"], "left")
    count = F.coalesce("_n", F.lit(0))
    reason = F.when(~F.col("in_base") & F.col("annotation").isNotNull(), F.when(count == 0, "target_absent_in_base_graph").when(count == 1, "target_found_in_other_module").otherwise("target_name_ambiguous_outside_expected_module"))
    return j.select("config_id", "base_config_id", "kind", "id", "overlay_key", "in_base", "annotation", reason.alias("reason"))


def overlay_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("config_id", "base_config_id", "kind").agg(
        F.count(F.lit(1)).alias("extension_total"), F.count_if("in_base").alias("overlaid"), F.count_if(~F.col("in_base")).alias("added"),
        F.count_if(F.col("in_base") & F.col("annotation").isNotNull()).alias("resolved_annotations"), F.count_if(~F.col("in_base") & F.col("annotation").isNotNull()).alias("unresolved_annotations"),
    )


def upsert(current: DataFrame, new: DataFrame, keys: list[str], of: DataFrame | None = None) -> DataFrame:
    """K7: the current rows whose key isn't among the new ones, and the new ones: all rows of a key are replaced. Keys with
    null replace keys with null. of: the keys to replace, where some of them may have no new rows."""
    k = (new if of is None else of).select(*[F.col(c).alias(f"_u_{c}") for c in keys]).distinct()
    kept = current.join(k, [F.col(c).eqNullSafe(F.col(f"_u_{c}")) for c in keys], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def freshness(changed: DataFrame, state: DataFrame, built_at: DataFrame) -> DataFrame:
    """V7: for each changed file whether the state is behind it, and whether the file is newer than what was built of its
    configuration: config_id, rel_path, stale, newer_than_graph. Of several state rows of a file the one written last
    holds. Where nothing was built, no file is newer than it."""
    st = state.groupBy("config_id", "rel_path").agg(F.max(F.struct("written_at", "mtime"))["mtime"].alias("_m"))
    b = built_at.groupBy("config_id").agg(F.max("built_at").alias("_b"))
    j = changed.join(st, ["config_id", "rel_path"], "left").join(b, "config_id", "left")
    return j.select("config_id", "rel_path", (~F.col("mtime").eqNullSafe(F.col("_m"))).alias("stale"), F.coalesce(F.col("mtime") > F.col("_b"), F.lit(False)).alias("newer_than_graph"))


def batch_validation(files: DataFrame, diagnostics: DataFrame, issues: DataFrame | None = None, server: bool | None = None) -> DataFrame:
    """V3: findings of a validator joined to files by path (any slash and letter case): config_id, file_path, errors,
    warnings, other, status: failed, passed_with_warnings, passed. server: whether a language server that was asked came to
    its end; if it did not, files without findings have passed_bootstrap_only."""
    path = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    from metascope.functions.text import severity_col

    found = diagnostics.select(path(F.col("file_path")).alias("_p"), severity_col(F.col("severity")).alias("_s"))
    if issues is not None:
        found = found.unionByName(issues.select(path(F.col("file_path")).alias("_p"), F.col("severity").alias("_s")))
    counts = found.groupBy("_p").agg(F.count_if(F.col("_s") == "error").alias("errors"), F.count_if(F.col("_s") == "warning").alias("warnings"), F.count(F.lit(1)).alias("_all"))
    j = files.select("config_id", "file_path").distinct().withColumn("_p", path(F.col("file_path"))).join(counts, "_p", "left")
    status = F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "passed_with_warnings").otherwise("passed_bootstrap_only" if server is False else "passed")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select("config_id", "file_path", zero(F.col("errors")).alias("errors"), zero(F.col("warnings")).alias("warnings"), zero(F.col("_all") - F.col("errors") - F.col("warnings")).alias("other"), status.alias("status"))


def post_change_status(v: DataFrame, impact: DataFrame, fresh: DataFrame, files: DataFrame, graph: DataFrame | None = None, server: bool | None = None) -> DataFrame:
    """V8: one row: counts and a status, the first that holds: no_files, failed_validation, incomplete_bsl_ls_validation (the
    server was asked and did not end), incomplete_graph (a graph is given and has no nodes), needs_reindex (a file is
    newer than the state or the graph), passed_with_warnings, ready_for_review."""
    one = lambda df, *aggs: df.agg(*aggs)
    a = one(files, F.count(F.lit(1)).alias("files"))
    b = one(v, F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    c = one(fresh, F.count_if("stale").alias("stale"), F.count_if("newer_than_graph").alias("newer"))
    e = one(impact, F.coalesce(F.sum("callers"), F.lit(0)).alias("callers"))
    g = one(graph.select("id").limit(1) if graph is not None else files.limit(0).select(F.lit("").alias("id")), (F.count(F.lit(1)) > 0).alias("_graph"))  # whether there is any
    row = a.crossJoin(b).crossJoin(c).crossJoin(e).crossJoin(g)  # tables of one row each
    status = F.when(F.col("files") == 0, "no_files").when(F.col("errors") > 0, "failed_validation").when(F.lit(server is False), "incomplete_bsl_ls_validation")
    status = status.when(F.lit(graph is not None) & ~F.col("_graph"), "incomplete_graph").when((F.col("newer") > 0) | (F.col("stale") > 0), "needs_reindex").when(F.col("warnings") > 0, "passed_with_warnings").otherwise("ready_for_review")
    return row.withColumn("status", status).drop("_graph")


#: From how many parts on a form is worth a hint.
LARGE_ELEMENTS, LARGE_COMMANDS, LARGE_EVENTS = 300, 100, 100


def form_hints(nodes: DataFrame, edges: DataFrame, elements: int = LARGE_ELEMENTS, commands: int = LARGE_COMMANDS, events: int = LARGE_EVENTS) -> DataFrame:
    """Hints on forms: config_id, form_id, hint, name, n. Hints: no_commands, no_elements, large_form, many_commands,
    many_events, duplicate_name, unresolved_handler; passive_command: a button or command element that invokes nothing,
    handles nothing, has no children and names no command; broken_command: an element that refers to a command and invokes
    none; hidden_top_level: how many elements at the top are not visible; command_without_handler: a command with an action
    that is handled by nothing. A part belongs to the form whose id its own id begins with (`kind:form:...`), which is
    how ids are made. Columns that the nodes don't have (command_ref, visible, action) count as null."""
    inner = F.regexp_extract("id", r"^[a-z_]+:(form:.*)\.[^.]*$", 1)
    for c, kind in (("command_ref", "string"), ("command_name", "string"), ("action", "string"), ("visible", "boolean")):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast(kind))
    n = nodes.filter("id is not null").groupBy("config_id", "id").agg(*[F.max(c).alias(c) for c in ("kind", "element_name", "element_type", "handler_name", "command_ref", "command_name", "action", "visible")])
    parts = n.filter(F.col("kind").isin("form_element", "command", "handler")).withColumn("form_id", inner).filter("form_id <> ''")
    count = parts.groupBy("config_id", "form_id").agg(F.count_if(F.col("kind") == "form_element").alias("e"), F.count_if(F.col("kind") == "command").alias("c"), F.count_if(F.col("kind") == "handler").alias("h"))
    forms = n.filter("kind = 'form'").select("config_id", F.col("id").alias("form_id")).join(count, ["config_id", "form_id"], "left").na.fill(0)
    hint = lambda df, name, label, value: df.select("config_id", "form_id", F.lit(name).alias("hint"), label.alias("name"), value.cast("bigint").alias("n"))
    none = F.lit(None).cast("string")
    out = hint(forms.filter("c = 0"), "no_commands", none, F.lit(0)).unionByName(hint(forms.filter("e = 0"), "no_elements", none, F.lit(0)))
    for name, col, least in (("large_form", "e", elements), ("many_commands", "c", commands), ("many_events", "h", events)):
        out = out.unionByName(hint(forms.filter(F.col(col) >= least), name, none, F.col(col)))
    names = parts.filter("kind = 'form_element' and element_name <> ''").groupBy("config_id", "form_id", "element_name").count().filter("count > 1")
    out = out.unionByName(hint(names, "duplicate_name", F.col("element_name"), F.col("count")))
    done = edges.filter("edge_type = 'implements_handler'").select("config_id", F.col("from_id").alias("id")).distinct()
    open_ = parts.filter("kind = 'handler'").join(done, ["config_id", "id"], "left_anti")
    out = out.unionByName(hint(open_, "unresolved_handler", F.col("handler_name"), F.lit(1)))
    from_ = lambda *types: edges.filter(F.col("edge_type").isin(*types)).select("config_id", F.col("from_id").alias("id")).distinct()
    to = lambda *types: edges.filter(F.col("edge_type").isin(*types)).select("config_id", F.col("to_id").alias("id")).distinct()
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    element = parts.filter("kind = 'form_element'")
    idle = element.filter(F.lower("element_type").rlike("button|command") & ~there("command_name")).join(from_("invokes_command", "handles_event", "contains_child_element"), ["config_id", "id"], "left_anti")
    out = out.unionByName(hint(idle, "passive_command", F.col("element_name"), F.lit(1)))
    broken = element.filter(there("command_ref")).join(from_("invokes_command"), ["config_id", "id"], "left_anti")
    out = out.unionByName(hint(broken, "broken_command", F.coalesce("element_name", "id"), F.lit(1)))
    hidden = element.filter("not visible").join(to("contains_element"), ["config_id", "id"], "left_semi").groupBy("config_id", "form_id").agg(F.count(F.lit(1)).alias("h"))
    out = out.unionByName(hint(hidden, "hidden_top_level", none, F.col("h")))
    unheard = parts.filter("kind = 'command'").filter(there("action")).join(from_("handled_by"), ["config_id", "id"], "left_anti")
    return out.unionByName(hint(unheard, "command_without_handler", F.col("command_name"), F.lit(1)))


def context(edges: DataFrame, limit: int = 20) -> DataFrame:
    """The first edges (by seq) of each node and section: config_id, id, section, other_id, place. Sections: references,
    forms, modules, uses (outgoing), referenced_by, used_by (incoming). Hot nodes
    are ranked in parts."""
    out = {"references_metadata": "references", "contains_form": "forms", "contains_module": "modules", "uses_metadata": "uses"}
    into = {"references_metadata": "referenced_by", "uses_metadata": "used_by"}
    name = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("edge_type")]
    a = edges.select("config_id", F.col("from_id").alias("id"), name(out).alias("section"), F.col("to_id").alias("other_id"), "seq")
    b = edges.select("config_id", F.col("to_id").alias("id"), name(into).alias("section"), F.col("from_id").alias("other_id"), "seq")
    rows = a.unionByName(b).filter("section is not null and id is not null").distinct()
    return first_rows(rows, ["config_id", "id", "section"], ["seq", "other_id"], limit).drop("seq")


def ordered_children(edges: DataFrame, nodes: DataFrame, edge_type: str = "declares_method", limit: int = 500) -> DataFrame:
    """The first children of each parent with their place in the order of (start_line, method_name, id); the limit is
    that of the list which is asked for. Hot parents are ranked in parts."""
    kids = nodes.groupBy("config_id", "id").agg(F.min("start_line").alias("start_line"), F.max("method_name").alias("method_name"))
    e = edges.filter(F.col("edge_type") == edge_type).select("config_id", F.col("from_id").alias("parent_id"), F.col("to_id").alias("id")).distinct()
    j = salted_join(e, kids, ["config_id", "id"], "inner", hot=hot_keys(e, ["config_id", "id"])).select("config_id", "parent_id", "id", "start_line", "method_name")
    return first_rows(j, ["config_id", "parent_id"], [F.col("start_line").asc_nulls_last(), F.col("method_name").asc_nulls_last(), F.col("id")], limit)
