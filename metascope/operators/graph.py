"""The property graph: building it from parsed files, merging repeated rows, reading neighbours."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metascope.functions.constants import FOLDERS
from metascope.operators.skew import salted_join
from metascope.runtime import cut
from metascope.sources.modules import call_candidates, metadata_usages

#: Attributes of which one, given anywhere, makes a node more than a placeholder.
EVIDENCE = ("file_path", "document", "synonym", "root_type", "module_path", "method_name", "element_name", "command_name", "handler_name")
EDGE_KEY = ("from_id", "to_id", "edge_type", "section", "container", "edge_source", "data_path", "event")
NODE_ATTRIBUTES = (
    "file_path", "document", "object_type", "object_name", "synonym", "form_name", "owner_type", "owner_object_type", "owner_name", "root_type", "module_type", "module_name", "module_path", "method_name",
    "start_line", "end_line", "extension_annotation", "extension_target_method", "command_name", "action", "title", "tooltip", "handler_name", "handler_kind", "event_name", "source_kind", "source_name",
    "element_id", "element_name", "element_type", "data_path", "command_ref", "visible", "enabled", "read_only", "parent_element_id", "parent_element_name", "depth", "event_count",
    "form_element_count", "form_event_count", "form_command_count",
)
_TYPES = {c: "int" for c in ("start_line", "end_line", "depth", "event_count", "form_element_count", "form_event_count", "form_command_count")} | {c: "boolean" for c in ("visible", "enabled", "read_only")}
EDGE_ATTRIBUTES = ("section", "container", "edge_source", "raw_type", "event", "resolution", "via_module", "namespace", "source_method", "data_path")


def _given(c: str, kind: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "") if kind == "string" else F.size(c) > 0 if kind.startswith(("array", "map")) else F.col(c).isNotNull()


def merge_nodes(nodes: DataFrame, keys: tuple[str, ...] = ("config_id", "id"), order: str = "node_seq", attributes: tuple[str, ...] | None = None) -> DataFrame:
    """G1: one row for each node. Of each attribute the last one that is given (not null, empty text or empty list) stays,
    by `order`; kind is the last one. is_stub is false once any row carries a piece of evidence or says so itself.
    max_by keeps partial results, so a node with very many rows is never gathered."""
    types = dict(nodes.dtypes)
    cols = [c for c in (attributes or nodes.columns) if c in types and c not in (*keys, order, "kind", "is_stub")]
    aggs = [F.max_by("kind", order).alias("kind")]
    aggs += [F.max_by(c, F.when(_given(c, types[c]), F.col(order))).alias(c) for c in cols]
    evidence = reduce(lambda a, b: a | b, [_given(c, types[c]) for c in EVIDENCE if c in types], F.lit(False))
    real = evidence | (~F.col("is_stub") if "is_stub" in types else F.lit(False))
    aggs.append((~F.bool_or(F.coalesce(real, F.lit(False)))).alias("is_stub"))
    return nodes.groupBy(*keys).agg(*aggs)


def dedupe_edges(edges: DataFrame, keys: tuple[str, ...] = EDGE_KEY, order: str = "seq") -> DataFrame:
    """The first edge by `order` of each key within its configuration; null and empty text are the same. By min_by of
    the whole row, which is combined before the shuffle."""
    key = [F.coalesce(F.col(k), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*edges.columns)
    return edges.select("config_id", *key, F.struct(order, row.alias("row")).alias("_row")).groupBy("config_id", *[f"_k{i}" for i in range(len(keys))]).agg(F.min("_row").alias("_row")).select("_row.row.*")


def stub_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that edges name and no node has: config_id, id, kind (the id's prefix)."""
    ends = edges.select("config_id", F.explode(F.array("from_id", "to_id")).alias("id")).filter("id is not null and trim(id) <> ''").distinct()
    known = nodes.select("config_id", "id").distinct()
    return ends.join(known, ["config_id", "id"], "left_anti").select("config_id", "id", F.substring_index("id", ":", 1).alias("kind"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per configuration of nodes by kind and edges by type: config_id, part, name, n."""
    n = nodes.groupBy("config_id", F.col("kind").alias("name")).count().withColumn("part", F.lit("node"))
    e = edges.groupBy("config_id", F.col("edge_type").alias("name")).count().withColumn("part", F.lit("edge"))
    return n.unionByName(e).select("config_id", "part", "name", F.col("count").alias("n"))


def adjacency(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """Degree and neighbours of each node by direction: config_id, id, direction, degree, block, neighbours (distinct,
    sorted). A node with more than `most` of them has several rows, each with the degree of the whole and one block of the
    list, of about `most` or less: the members with one hash of theirs. The blocks are disjoint and together complete."""
    ends = edges.select("config_id", F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit("outgoing").alias("direction"), F.col("to_id").alias("other")), F.struct(F.col("to_id").alias("id"), F.lit("incoming").alias("direction"), F.col("from_id").alias("other")))).alias("e"))
    keys = ["config_id", "id", "direction"]
    pairs = ends.select("config_id", "e.*").filter("id is not null").groupBy(*keys, "other").agg(F.count(F.lit(1)).alias("n"))
    degree = pairs.groupBy(*keys).agg(F.sum("n").alias("_degree"), F.count("other").alias("_m"))
    large = degree.filter(F.col("_m") > most).select(*keys, "_degree", F.ceil(F.col("_m") / most).alias("_blocks"))  # few rows: at most one for each `most` pairs
    part = pairs.join(large, keys, "left").filter("other is not null or _blocks is null").withColumn("block", F.coalesce(F.pmod(F.xxhash64("other"), F.col("_blocks")) + 1, F.lit(1)).cast("int"))
    return part.groupBy(*keys, "block").agg(F.coalesce(F.max("_degree"), F.sum("n")).alias("degree"), F.array_join(F.sort_array(F.collect_set("other")), "|").alias("neighbours")).select(*keys, "degree", "block", "neighbours")


def find_nodes(nodes: DataFrame, kind: str | None = None, limit: int | None = 20, order: str = "node_seq", **equal) -> DataFrame:
    """Nodes of a kind whose attributes equal all given values, in order; `limit` of them, None for all."""
    for k, v in (({"kind": kind} if kind else {}) | equal).items():
        nodes = nodes.filter(F.col(k) == v)
    return nodes.orderBy(order, "id").limit(limit) if limit is not None else nodes


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "outgoing", edge_type: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Each edge with its neighbour's attributes, or nulls where the node is missing: the edge's columns and
    n_kind, n_file_path, n_name. ids: only edges of these (config_id, id). Hot neighbours are salted."""
    if direction not in ("outgoing", "incoming"):
        raise ValueError(f"direction {direction!r}")
    own, other = ("from_id", "to_id") if direction == "outgoing" else ("to_id", "from_id")
    e = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    if ids is not None:
        e = e.join(ids.select("config_id", F.col("id").alias(own)).distinct(), ["config_id", own], "left_semi")
    name = F.coalesce("object_name", "form_name", "module_path", "method_name", "command_name", "handler_name", "element_name") if "object_name" in nodes.columns else F.col("id")
    known = nodes.select("config_id", F.col("id").alias("key"), F.col("kind").alias("n_kind"), F.col("file_path").alias("n_file_path"), name.alias("n_name"))
    return salted_join(e.withColumn("key", F.col(other)), known, ["config_id", "key"], "left").drop("key", "_r_config_id", "_r_key")


def unique_resolution(calls: DataFrame, targets: DataFrame, keys: list[str], source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Calls that have exactly one target other than themselves. Candidates are counted, not gathered: of each key the
    number of targets and one of them (two are enough to know)."""
    t = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(target).alias("_one"), F.max(target).alias("_two"))
    j = calls.join(t, keys)
    mine = targets.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col(target).alias("_self"))
    j = j.join(mine, [F.col(k) == F.col(f"_s_{k}") for k in keys] + [F.col(source) == F.col("_self")], "left")
    others = F.col("_n") - F.col("_self").isNotNull().cast("int")
    hit = F.when(F.col("_self").isNull() | (F.col("_one") != F.col(source)), F.col("_one")).otherwise(F.col("_two"))
    return j.filter(others == 1).select(*calls.columns, hit.alias(target))


# --- building ---------------------------------------------------------------------------------------------------------


def _id(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix + ":"), F.concat_ws(".", *parts))


def _form_id() -> Column:
    owner = F.when(F.col("owner_name") != "", F.concat_ws(".", "owner_object_type", "owner_name")).otherwise(F.col("owner_object_type"))
    return _id("form", owner, F.col("form_name"))


def _node(df: DataFrame, ident: Column, kind: str, **attrs) -> DataFrame:
    cols = [F.col("config_id"), ident.alias("id"), F.lit(kind).alias("kind")]
    cols += [(attrs[a] if isinstance(attrs.get(a), Column) else F.col(attrs[a]) if a in attrs else F.lit(None)).cast(_TYPES.get(a, "string")).alias(a) for a in NODE_ATTRIBUTES]
    return df.select(*cols, F.col("_order").alias("node_seq"))


def _edge(df: DataFrame, a: Column, b: Column, kind: str, **attrs) -> DataFrame:
    cols = [(attrs[x] if isinstance(attrs.get(x), Column) else F.col(attrs[x]) if x in attrs else F.lit(None)).cast("string").alias(x) for x in EDGE_ATTRIBUTES]
    return df.select("config_id", a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("edge_type"), *cols, F.col("_order").alias("seq"))


def build_graph(objects: DataFrame, forms: DataFrame, methods: DataFrame, modules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed descriptors, forms and methods. Rows of one file come in the order of its
    path, so that the last given attribute and the first edge are the same in every run. Handlers are linked to the
    method of that name in the form's own module, elements to the element above or to the form and to commands that
    exist, calls to their only target, and every object that is named but not described becomes a placeholder. modules: all modules, with those that hold no method."""
    order = lambda df, *within: df.withColumn("_order", F.struct(F.col("rel_path"), *[F.coalesce(w, F.lit(0)).cast("int") for w in within], *[F.lit(0)] * (2 - len(within))).cast("struct<p:string,i:int,j:int>"))
    o, f, m = order(cut(objects)), order(cut(forms)), order(cut(methods), F.col("start_line"))  # each file is parsed once
    meta = lambda kind, name: _id("metadata", kind, name)
    nodes, edges = [], []
    # objects and what they refer to
    oid = meta(F.col("object_type"), F.col("object_name"))
    nodes.append(_node(o, oid, "metadata", object_type="object_type", object_name="object_name", synonym="synonym", file_path="file_path", document="document"))
    refs = o.select("config_id", "_order", oid.alias("_o"), F.explode("refs").alias("r")).select("config_id", "_order", "_o", "r.*")
    rid = meta(F.col("target_type"), F.col("target_name"))
    nodes.append(_node(refs, rid, "metadata", object_type="target_type", object_name="target_name"))
    edges.append(_edge(refs, F.col("_o"), rid, "references_metadata", section="section", container="container", edge_source="source", raw_type="raw_type"))
    # modules and methods
    every = m if modules is None else m.select("config_id", "module_path", "module_type", "module_name", "rel_path", "_order").unionByName(order(modules).select("config_id", "module_path", "module_type", "module_name", "rel_path", "_order"))
    mods = every.groupBy("config_id", "module_path", "module_type", "module_name", "rel_path").agg(F.min("_order").alias("_order"))
    folder = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    mid = _id("module", F.col("module_path"))
    nodes.append(_node(mods, mid, "module", module_type="module_type", module_name="module_name", module_path="module_path", file_path="rel_path"))
    owned = mods.withColumn("_t", folder[F.col("module_type")]).filter("_t is not null and module_name <> ''")
    nodes.append(_node(owned, meta(F.col("_t"), F.col("module_name")), "metadata", object_type="_t", object_name="module_name"))
    edges.append(_edge(owned, meta(F.col("_t"), F.col("module_name")), mid, "contains_module"))
    method_id = F.concat(F.lit("method:"), "module_path", F.lit("."), "method_name", F.lit(":"), "start_line")
    nodes.append(_node(m, method_id, "method", module_type="module_type", module_name="module_name", module_path="module_path", method_name="method_name", start_line="start_line", end_line="end_line",
                       extension_annotation="annotation", extension_target_method="target_method", file_path="rel_path", document="body"))
    edges.append(_edge(m, mid, method_id, "declares_method"))
    # forms
    fid = _form_id()
    nodes.append(_node(f, fid, "form", form_name="form_name", owner_type="owner_type", owner_object_type="owner_object_type", owner_name="owner_name", root_type="root_type", file_path="file_path", document="document",
                       form_element_count=F.size("elements"), form_event_count=F.size("events"), form_command_count=F.size("commands")))
    fo = f.filter("owner_object_type <> '' and owner_name <> ''")
    nodes.append(_node(fo, meta(F.col("owner_object_type"), F.col("owner_name")), "metadata", object_type="owner_object_type", object_name="owner_name"))
    edges.append(_edge(fo, meta(F.col("owner_object_type"), F.col("owner_name")), fid, "contains_form"))
    form_module = F.when(F.col("owner_type") == "CommonForms", F.concat(F.lit("CommonForms."), "form_name", F.lit(".FormModule"))).otherwise(F.concat("owner_type", F.lit("."), "owner_name", F.lit(".Forms."), "form_name", F.lit(".FormModule")))
    fm = f.select("config_id", "_order", fid.alias("_f"), form_module.alias("module_path"), "form_name", "commands", "events", "elements")
    have = mods.select("config_id", "module_path").distinct()
    edges.append(_edge(fm.join(have, ["config_id", "module_path"], "left_semi"), F.col("_f"), mid, "has_form_module"))
    last_method = m.groupBy("config_id", "module_path", "method_name").agg(F.max_by(method_id, "start_line").alias("_method"))
    # commands
    c = fm.select("config_id", "_order", "_f", "module_path", "form_name", F.explode("commands").alias("c")).select("config_id", "_order", "_f", "module_path", "form_name", "c.*").filter("name <> ''")
    cid = F.concat(F.lit("command:"), "_f", F.lit("."), "name")
    nodes.append(_node(c, cid, "command", command_name="name", action="action", title="title", tooltip="tooltip", form_name="form_name"))
    edges.append(_edge(c, F.col("_f"), cid, "contains_command"))
    act = c.filter("action <> ''")
    hid = lambda h: F.concat(F.lit("handler:"), "_f", F.lit("."), h)
    nodes.append(_node(act, hid(F.col("action")), "handler", handler_name="action", handler_kind=F.lit("command"), form_name="form_name"))
    edges.append(_edge(act, cid, hid(F.col("action")), "handled_by", edge_source="name"))
    # elements and events
    e = fm.select("config_id", "_order", "_f", "module_path", "form_name", F.explode("elements").alias("e")).select("config_id", "_order", "_f", "module_path", "form_name", "e.*")
    eid = F.concat(F.lit("form_element:"), "_f", F.lit("."), "element_id")
    nodes.append(_node(e, eid, "form_element", form_name="form_name", event_count=F.size("events"), **{x: x for x in ("element_id", "element_name", "element_type", "title", "data_path", "command_name", "command_ref", "visible", "enabled", "read_only", "parent_element_id", "parent_element_name", "depth")}))
    up = F.concat(F.lit("form_element:"), "_f", F.lit("."), "parent_element_id")
    edges.append(_edge(e.filter("parent_element_id <> ''"), up, eid, "contains_child_element"))
    edges.append(_edge(e.filter("parent_element_id = ''"), F.col("_f"), eid, "contains_element"))
    known = c.select("config_id", "_f", F.col("name").alias("command_ref")).distinct()
    edges.append(_edge(e.filter("command_ref <> ''").join(known, ["config_id", "_f", "command_ref"], "left_semi"), eid, F.concat(F.lit("command:"), "_f", F.lit("."), "command_ref"), "invokes_command", edge_source="command_name"))
    ee = e.select("config_id", "_order", "_f", "module_path", "form_name", eid.alias("_from"), F.col("element_type").alias("source_kind"), F.col("element_name").alias("source_name"), F.lit("element_event").alias("handler_kind"), F.explode("events").alias("v")).select("*", "v.*").drop("v")
    fe = fm.select("config_id", "_order", "_f", "module_path", "form_name", F.col("_f").alias("_from"), F.lit("event").alias("handler_kind"), F.explode("events").alias("v")).select("*", "v.*").drop("v")
    ev = ee.unionByName(fe).filter("handler <> ''")
    nodes.append(_node(ev, hid(F.col("handler")), "handler", handler_name="handler", handler_kind="handler_kind", event_name="event", source_kind="source_kind", source_name="source_name", form_name="form_name"))
    edges.append(_edge(ev, F.col("_from"), hid(F.col("handler")), "handles_event", edge_source="source_name", event="event"))
    links = ev.select("config_id", "_order", "_f", "module_path", F.col("handler").alias("method_name"), "source_name", "event").unionByName(act.select("config_id", "_order", "_f", "module_path", F.col("action").alias("method_name"), F.col("name").alias("source_name"), F.lit("command").alias("event")))
    linked = links.join(last_method, ["config_id", "module_path", "method_name"])
    edges.append(_edge(linked, hid(F.col("method_name")), F.col("_method"), "implements_handler", edge_source="source_name", event="event"))
    # calls and uses
    call = cut(m.select("config_id", "_order", method_id.alias("source_id"), "module_path", F.col("method_name").alias("source_method"), F.explode(call_candidates(F.col("body"))).alias("x")).select("config_id", "_order", "source_id", "module_path", "source_method", F.col("x.kind").alias("resolution"), F.col("x.module_name").alias("module_name"), F.col("x.method_name").alias("method_name")))  # bodies are searched once
    target = m.select("config_id", "module_path", "module_name", "method_name", method_id.alias("target_id")).distinct()  # files may be given twice
    near = unique_resolution(call.filter("resolution = 'local'").drop("module_name"), target.select("config_id", "module_path", "method_name", "target_id"), ["config_id", "module_path", "method_name"]).withColumn("module_name", F.lit(None).cast("string"))
    far = unique_resolution(call.filter("resolution = 'qualified'"), target.select("config_id", "module_name", "method_name", "target_id"), ["config_id", "module_name", "method_name"])
    edges.append(_edge(near.unionByName(far), F.col("source_id"), F.col("target_id"), "calls", edge_source="method_name", resolution="resolution", via_module="module_name", source_method="source_method"))
    use = cut(m.select("config_id", "_order", method_id.alias("source_id"), F.col("method_name").alias("source_method"), F.explode(metadata_usages(F.col("body"))).alias("u")).select("config_id", "_order", "source_id", "source_method", "u.*"))
    uid = meta(F.col("object_type"), F.col("object_name"))
    nodes.append(_node(use, uid, "metadata", object_type="object_type", object_name="object_name"))
    edges.append(_edge(use, F.col("source_id"), uid, "uses_metadata", namespace="namespace", edge_source=F.concat_ws(".", "namespace", "object_name"), source_method="source_method"))
    all_nodes = merge_nodes(reduce(DataFrame.unionByName, nodes).withColumn("is_stub", F.lit(True)))
    all_edges = dedupe_edges(reduce(DataFrame.unionByName, edges))
    return all_nodes, all_edges


# --- trees ------------------------------------------------------------------------------------------------------------


def element_tree(edges: DataFrame, top: DataFrame, edge_type: str = "contains_child_element", most_levels: int | None = None) -> DataFrame:
    """Every element below the given top ones, level by level: config_id, root_id, id, depth. An element is taken at its
    first level below each root, so cycles end. One join a level over the edges of that type, until a level is empty; a tree
    of more than `most_levels` levels, if given, is an error."""
    step = cut(edges.filter(F.col("edge_type") == edge_type).select("config_id", F.col("from_id").alias("id"), F.col("to_id").alias("_to")).filter("id is not null and _to is not null").distinct())
    level = cut(top.select("config_id", F.col("id").alias("root_id"), "id").distinct().withColumn("depth", F.lit(0)))
    out = level
    for depth in count(1):
        nxt = level.join(step, ["config_id", "id"]).select("config_id", "root_id", F.col("_to").alias("id")).distinct()
        level = cut(nxt.join(out.select("config_id", "root_id", "id"), ["config_id", "root_id", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return out
        if most_levels is not None and depth >= most_levels:
            raise ValueError(f"the tree has more than {most_levels} levels")
        out = out.unionByName(level)
        if depth % 50 == 0:  # keeps the plan small in deep trees
            out = cut(out)
