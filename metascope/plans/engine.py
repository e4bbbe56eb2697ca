"""The tools of the query surface over one configuration; each returns a DataFrame, limits are those of a report."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metascope.functions import text as t
from metascope.operators import graph, impact, search, vectors
from metascope.operators.ledger import newest_versions, pending_files, state_rows
from metascope.sources import descriptors, exports, language_server, modules
from metascope.runtime import cut, ship
from metascope.sources.sinks import TableStore, write_graph

TABLES = ("nodes", "edges", "chunks", "configs", "export_files", "index_state", "index_runs", "diagnostics")


def clamp(limit: int, most: int, least: int = 1) -> int:
    return max(least, min(int(limit), most))


@dataclass(frozen=True)
class Engine:
    """Tables and a configuration. for_config gives the same engine for another one; nothing is changed in place.

    embeddings: table with (id, embedding) of chunks, or None: then searches go by words alone. embedder: text and length to
    a vector. rules: the domain's own rules, if any."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    config_id: str
    embeddings: DataFrame | None = None
    embedder: object = vectors.hash_embedding
    rules: tuple[search.Rule, ...] = ()

    @classmethod
    def open(cls, spark: SparkSession, folder: str, config_id: str, **more) -> Engine:
        ship(spark)
        return cls(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in TABLES}, config_id, **more)

    def for_config(self, config_id: str) -> Engine:
        """W13, switch_configuration: raises KeyError for a configuration that isn't registered."""
        if self.tables["configs"].filter(F.col("config_id") == config_id).isEmpty():
            raise KeyError(config_id)
        return replace(self, config_id=config_id)

    def with_vectors(self) -> Engine:
        """The same engine with vectors of this configuration's chunks and commands by its embedder."""
        docs = self.tables["chunks"].filter(F.col("config_id") == self.config_id).select("id", "document").unionByName(self.nodes_of("command").select("id", F.concat_ws(" ", "command_name", "document").alias("document")))
        return replace(self, embeddings=cut(vectors.embed(docs.filter("id is not null and document is not null").dropDuplicates(["id"]), "document", embedder=self.embedder).select("id", "embedding")))

    # --- tables of the configuration
    def _own(self, name: str) -> DataFrame:
        return self.tables[name].filter(F.col("config_id") == self.config_id).distinct()

    @cached_property
    def nodes(self) -> DataFrame:
        n = self.tables["nodes"].filter((F.col("config_id") == self.config_id) & F.col("deleted_at").isNull()).drop("recorded_at", "deleted_at")
        for c in ("owner_object_type", "action", "title", "tooltip", "module_name", "extension_annotation"):
            if c not in n.columns:
                n = n.withColumn(c, F.lit(None).cast("string"))
        return graph.merge_nodes(n)

    @cached_property
    def edges(self) -> DataFrame:
        return self._own("edges")

    @cached_property
    def files(self) -> DataFrame:
        f = self.tables["export_files"].filter(F.col("config_id") == self.config_id)
        return f.join(newest_versions(f).select("file_id"), "file_id", "left_semi").dropDuplicates(["file_id"])

    def chunks(self, kind: str) -> DataFrame:
        c = self.tables["chunks"].filter((F.col("config_id") == self.config_id) & (F.col("chunk_type") == kind))
        return c.dropDuplicates(["id"])

    def nodes_of(self, kind: str) -> DataFrame:
        return self.nodes.filter(F.col("kind") == kind)

    @cached_property
    def objects(self) -> DataFrame:
        """Object chunks; nodes of objects that have none."""
        c = self.chunks("metadata").select("object_type", "object_name", "synonym", "document", "file_path", "id")
        n = self.nodes_of("metadata").select("object_type", "object_name", "synonym", "document", "file_path", F.lit(None).cast("string").alias("id"))
        return c.unionByName(n.join(c.select("object_type", "object_name"), ["object_type", "object_name"], "left_anti"))

    @cached_property
    def forms(self) -> DataFrame:
        """S7."""
        n = self.nodes_of("form").select("id", "form_name", "owner_name", F.regexp_extract("id", r"^form:([^.]*)", 1).alias("owner_object_type"), "file_path")
        return n

    @cached_property
    def code(self) -> DataFrame:
        return self.chunks("code").select("id", "module_path", "module_type", "module_name", "method_name", "start_line", "end_line", "file_path", "document")

    @cached_property
    def modules(self) -> DataFrame:
        """S9."""
        s = self.chunks("code_module_summary").groupBy("module_path").agg(F.max("module_type").alias("_t"), F.max("file_path").alias("_f"), F.max("document").alias("document"), F.max("id").alias("id"))
        n = self.nodes_of("module").filter("module_path is not null").groupBy("module_path").agg(F.max("module_type").alias("module_type"), F.max("file_path").alias("file_path"))
        return n.join(s, "module_path", "left").select("module_path", F.coalesce("_t", "module_type").alias("module_type"), F.split_part("module_path", F.lit("."), F.lit(2)).alias("module_name"), F.coalesce("_f", "file_path").alias("file_path"), F.coalesce("document", F.lit("")).alias("document"), "id")

    @cached_property
    def commands(self) -> DataFrame:
        """Command nodes with the form that contains them."""
        owner = self.edges.filter("edge_type = 'contains_command'").groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("form_id"))
        forms = self.forms.select(F.col("id").alias("form_id"), "owner_name", F.col("form_name").alias("_form"))
        c = self.nodes_of("command").select("id", "command_name", "action", "title", "tooltip", "form_name", F.coalesce("document", F.lit("")).alias("document"))
        return c.join(owner, "id", "left").join(forms, "form_id", "left").withColumn("form_name", F.coalesce("form_name", "_form")).drop("_form")

    @cached_property
    def subscriptions(self) -> DataFrame:
        """From chunks; from the export's files where there are none."""
        c = self.chunks("metadata_event_subscription").select("id", "subscription_name", "synonym", "event", "handler_module", "handler_method", "sources", "document")
        f = descriptors.subscriptions(self.files).select(F.lit(None).cast("string").alias("id"), "subscription_name", "synonym", "event", "handler_module", "handler_method", "sources", "document")
        both = c.unionByName(f.join(c.select("subscription_name"), "subscription_name", "left_anti")).dropDuplicates(["subscription_name"])
        return both.withColumns({"handler": F.concat_ws(".", "handler_module", "handler_method"), "sources_text": F.array_join("sources", " ")})

    # --- searching
    def _cosine(self, queries: list[str], df: DataFrame, fetch: int) -> DataFrame | None:
        """The `fetch` rows of `df` (with id) nearest to each query, with _cos, the best over the queries."""
        if self.embeddings is None:
            return None
        e = self.embeddings.select("id", "embedding").join(df.select("id").filter("id is not null").distinct(), "id", "left_semi")
        row = e.select(F.size("embedding").alias("n")).head(1)
        if not row:
            return None
        asked = self.spark.createDataFrame([(str(i), [float(x) for x in self.embedder(q, row[0]["n"])]) for i, q in enumerate(queries)], "id string, embedding array<float>")
        near = vectors.topk(e, asked, fetch, "id", "embedding", 6).groupBy("id").agg(F.max("score").alias("_cos"))
        return df.join(near, "id")

    def _fused(self, queries: list[str], fetch: int, df: DataFrame, columns: list[str], by_vector, by_words, more: dict[str, DataFrame], key: list[str], explain: bool = False, least: float = 0.0) -> DataFrame:
        ranks = {}
        v = self._cosine(queries, df, fetch)
        if v is not None:
            ranks["vector"] = search.scored(search.prepared(v, *columns), by_vector, F.col("_cos"), explain).drop("_cos")
        if by_words is not None:
            ranks["lexical"] = search.scored(search.prepared(df, *columns), by_words, explain=explain).filter(F.col("score") > least)
        return vectors.fuse(ranks | more, key)

    def search_metadata(self, query: str, limit: int = 5, explain: bool = False) -> DataFrame:
        """Objects by vector, by words and by lookup, fused."""
        q = search.Question(query, self.rules)
        looked = {f"lookup{i}": search.scored(search.prepared(self.objects, "object_name", "synonym"), search.lookup_parts(q, x, explain), explain=explain).filter("score > 1.5") for i, x in enumerate(q.lookups())}
        f = self._fused(q.retrieval(), max(20 * limit, 80), self.objects, ["object_name", "synonym", "document"], search.object_parts(q, "vector"), search.object_parts(q, "lexical"), looked, ["object_type", "object_name"], explain)
        return search.top(f, clamp(limit, 50), "object_type", "object_name")

    def search_code(self, query: str, limit: int = 5, explain: bool = False) -> DataFrame:
        """Methods by vector and by words, fused. Raises ValueError without vectors of code."""
        if not self.embedding_status()["ready"]:
            raise ValueError("this search needs vectors, and there are none")
        q = search.Question(query, self.rules)
        f = self._fused(q.code_retrieval(), max(30 * limit, 150), self.code, ["method_name", "module_path", "document"], search.code_parts(q, "vector"), search.code_parts(q, "lexical"), {}, ["file_path", "method_name", "start_line"], explain)
        return search.top(f, clamp(limit, 50), "file_path", "method_name", "start_line")

    def explain_search_result(self, query: str, target: str = "auto", limit: int = 3) -> DataFrame:
        """The best results with the parts of their scores; target: metadata, code or auto (both)."""
        if target not in ("auto", "metadata", "code"):
            raise ValueError(target)
        parts = []
        if target != "code":
            parts.append(self.search_metadata(query, limit, True).select(F.lit("metadata").alias("target"), F.concat_ws(".", "object_type", "object_name").alias("label"), "score", "source", "sources", "components"))
        if target != "metadata":
            parts.append(self.search_code(query, limit, True).select(F.lit("code").alias("target"), F.concat_ws(".", "module_path", "method_name").alias("label"), "score", "source", "sources", "components"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def search_modules(self, query: str, limit: int = 5) -> DataFrame:
        """Modules by the vectors of their summaries; by their names where there are none."""
        q, n = search.Question(query, self.rules), clamp(limit, 20)
        v = self._cosine([query], self.modules.filter("id is not null"), max(50, 10 * n))
        if v is None:
            return self.find_module(query, None, n)
        rows = search.scored(search.prepared(v, "module_path", "module_name", "document"), search.module_vector_parts(q), F.col("_cos"))
        return search.top(rows, n, "module_path")

    def search_commands(self, query: str, limit: int = 10) -> DataFrame:
        """Commands by vector and by words, fused."""
        q, n = search.Question(query, self.rules), clamp(limit, 30)
        parts = search.command_parts(q)
        f = self._fused([query], max(50, 10 * n), self.commands, ["command_name", "action", "title", "tooltip", "form_name", "document"], parts, parts, {}, ["id"])
        return search.top(f, n, "id", least=0.01)

    def search_event_subscriptions(self, query: str, limit: int = 10) -> DataFrame:
        """Subscriptions by vector and by words, fused."""
        q, n = search.Question(query, self.rules), clamp(limit, 30)
        parts = search.subscription_parts(q)
        f = self._fused([query], max(50, 10 * n), self.subscriptions.withColumnRenamed("sources", "source_types"), ["subscription_name", "handler", "event", "synonym", "sources_text", "document"], parts, parts, {}, ["subscription_name"])
        return search.top(f, n, "subscription_name", least=0.01)

    # --- finding
    def find_metadata_object(self, name: str, object_type: str | None = None, limit: int = 10) -> DataFrame:
        """N4."""
        rows = search.prepared(self.objects.select("object_type", "object_name", "synonym", "file_path").distinct(), "object_name", "synonym")
        return search.top(search.scored(rows, search.object_lookup_parts(name, self._type(object_type))), clamp(limit, 50), "object_type", "object_name", least=1.0)

    @staticmethod
    def _type(name: str | None) -> str | None:
        """Q7: a type as named, or as its word says."""
        return (t.object_type(name) or name) if name else None

    def find_form(self, name: str, owner_name: str | None = None, owner_type: str | None = None, limit: int = 10) -> DataFrame:
        """N5."""
        return search.top(search.scored(search.prepared(self.forms, "form_name", "owner_name", "owner_object_type"), search.form_parts(name, owner_name, self._type(owner_type))), clamp(limit, 50), "id", least=1.2)

    def find_module(self, name: str, module_type: str | None = None, limit: int = 10) -> DataFrame:
        """N10, F12."""
        return search.top(search.scored(search.prepared(self.modules, "module_path", "module_name"), search.module_parts(name, module_type)), clamp(limit, 50), "module_path", least=1.0)

    def find_common_module(self, name: str, limit: int = 10) -> DataFrame:
        """N11."""
        return search.top(search.scored(search.prepared(self.modules.filter("module_type = 'CommonModules'"), "module_path", "module_name"), search.module_parts(name)), clamp(limit, 50), "module_path", least=1.0)

    def find_method(self, name: str, module_path: str | None = None, module_type: str | None = None, limit: int = 10) -> DataFrame:
        """Exact names first, then by likeness, then by vector, in one plan: the vectors count only for what the names
        leave below the threshold."""
        rows, n = self.code.drop("document"), clamp(limit, 50)
        ranks = {"name": search.scored(search.prepared(rows, "method_name", "module_path"), search.method_parts(name, module_path, module_type)).filter("score >= 1.4")}
        v = self._cosine([name], rows, max(20 * n, 100)) if self.embeddings is not None else None
        if v is not None:
            near = search.scored(search.prepared(v, "method_name", "module_path"), search.method_parts(name, module_path, module_type, True), F.col("_cos")).drop("_cos")
            ranks["vector"] = near.withColumn("score", F.least(F.col("score"), F.lit(1.399999)))  # below every hit by name
        return search.top(vectors.fuse(ranks, ["id"]).drop("sources"), n, "module_path", "start_line", "id")

    def list_module_methods(self, name: str, module_type: str | None = None, limit: int = 50) -> DataFrame:
        """Methods of the best matching module, by line and name."""
        best = self.find_module(name, module_type, 1).select("module_path")
        return self.nodes_of("method").join(best, "module_path", "left_semi").select("module_path", "method_name", "start_line", "end_line", "id").orderBy(F.col("start_line").asc_nulls_last(), "method_name", "id").limit(clamp(limit, 500))

    def list_object_forms(self, name: str, object_type: str | None = None) -> DataFrame:
        """N13."""
        best = self._object_ids(name, object_type)
        return self._near(best, "outgoing", "contains_form").select("to_id", F.col("n_name").alias("form_name"), F.col("n_file_path").alias("file_path")).distinct().orderBy("form_name", "file_path")

    # --- graph
    def _object_ids(self, name: str, object_type: str | None) -> DataFrame:
        best = self.find_metadata_object(name, object_type, 1)
        return best.select(F.lit(self.config_id).alias("config_id"), F.concat(F.lit("metadata:"), "object_type", F.lit("."), "object_name").alias("id"))

    def _method_ids(self, name: str, module_path: str | None, module_type: str | None = None) -> DataFrame:
        best = self.find_method(name, module_path, module_type, 1).select("module_path", "method_name", "start_line")
        return best.select(F.lit(self.config_id).alias("config_id"), F.concat(F.lit("method:"), "module_path", F.lit("."), "method_name", F.lit(":"), "start_line").alias("id"))

    def _near(self, ids: DataFrame, direction: str, *edge_types: str) -> DataFrame:
        e = self.edges.filter(F.col("edge_type").isin(*edge_types)) if edge_types else self.edges
        return graph.neighbours(e, self.nodes, direction, None, ids)

    def find_usages(self, name: str, object_type: str | None = None, limit: int = 20) -> DataFrame:
        """What refers to the object or uses it; for a name that is no object's, the callers of the method."""
        ids = self._object_ids(name, object_type)
        if not object_type and ids.isEmpty():
            return self.get_callers(name, limit=limit)
        return self._near(ids, "incoming", "references_metadata", "uses_metadata").select("edge_type", "from_id", "to_id", "section", "edge_source", "n_kind", "n_name", "seq").orderBy("seq").limit(clamp(limit, 200))

    def get_callers(self, name: str, module_path: str | None = None, module_type: str | None = None, limit: int = 20) -> DataFrame:
        """N16."""
        return self._near(self._method_ids(name, module_path, module_type), "incoming", "calls").select("from_id", "to_id", "resolution", "n_name", "n_file_path", "seq").orderBy("seq").limit(clamp(limit, 200))

    def get_callees(self, name: str, module_path: str | None = None, module_type: str | None = None, limit: int = 20) -> DataFrame:
        """N17."""
        return self._near(self._method_ids(name, module_path, module_type), "outgoing", "calls").select("from_id", "to_id", "resolution", "n_name", "n_file_path", "seq").orderBy("seq").limit(clamp(limit, 200))

    def get_dependencies(self, name: str, object_type: str | None = None) -> DataFrame:
        """References, forms and modules of an object; from its card where the graph has none."""
        ids = self._object_ids(name, object_type)
        g = self._near(ids, "outgoing", "references_metadata", "contains_form", "contains_module").select("edge_type", "to_id", "section", "edge_source", F.lit("graph").alias("origin"))
        cards = self.objects.select(F.concat(F.lit("metadata:"), "object_type", F.lit("."), "object_name").alias("key"), "document").join(ids.select(F.col("id").alias("key")), "key", "left_semi")
        c = modules.card_dependencies(cards).select(F.lit("references_metadata").alias("edge_type"), F.concat(F.lit("metadata:"), "target_type", F.lit("."), "target_name").alias("to_id"), "section", F.col("source").alias("edge_source"), F.lit("card").alias("origin"))
        return g.unionByName(c.join(g.select("to_id"), "to_id", "left_anti"))

    def get_file_snippet(self, path: str, first: int, last: int) -> DataFrame:
        """Lines of one file, by its path or the end of it. Bytes that are not UTF-8 and a byte order mark are left out."""
        rel = exports.slashes(F.col("rel_path"))
        p = path.replace("\\", "/")
        hit = self.files.filter((rel == p) | rel.endswith("/" + p) | (exports.slashes(F.col("file_path")) == p))
        return exports.line_snippet(modules.texts(hit), "rel_path", "text", first, last)

    def form_structure_report(self, name: str, owner_name: str | None = None, owner_type: str | None = None, limit: int = 30) -> DataFrame:
        """Parts of the best matching form, with their depth, and hints: section, id, name, detail."""
        best = self.find_form(name, owner_name, owner_type, 1).select("id")
        ids = best.withColumn("config_id", F.lit(self.config_id))
        direct = self._near(ids, "outgoing", "has_form_module", "contains_command", "contains_element", "handles_event").select(F.col("edge_type").alias("section"), F.col("to_id").alias("id"), F.col("n_name").alias("name"), F.coalesce("event", F.lit("")).alias("detail"))
        tops = self.edges.filter("edge_type = 'contains_element'").join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select("config_id", F.col("to_id").alias("id"))
        tree = graph.element_tree(self.edges, tops).select(F.lit("element").alias("section"), "id", F.substring_index("id", ".", -1).alias("name"), F.concat(F.lit("depth "), "depth").alias("detail"))
        hints = impact.form_hints(self.nodes, self.edges).join(best.select(F.col("id").alias("form_id")), "form_id", "left_semi").select(F.lit("hint").alias("section"), F.col("form_id").alias("id"), F.col("hint").alias("name"), F.concat_ws(" ", "name", F.col("n").cast("string")).alias("detail"))
        rows = direct.unionByName(tree).unionByName(hints)
        from pyspark.sql import Window

        n = clamp(limit, 120)
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy("section").orderBy("id", "name", "detail"))).filter(F.col("_n") <= n).drop("_n")

    # --- workflow
    def change_impact_report(self, name: str, object_type: str | None = None, limit: int = 20) -> DataFrame:
        """What a change of an object or a method touches: section, other_id."""
        n = clamp(limit, 80)
        exact = object_type is None and not self.code.filter(F.lower("method_name") == name.lower()).isEmpty()
        if exact:
            ids = self._method_ids(name, None)
            calls = self._near(ids, "incoming", "calls").select(F.lit("callers").alias("section"), F.col("from_id").alias("other_id"), "seq")
            calls = calls.unionByName(self._near(ids, "outgoing", "calls").select(F.lit("callees").alias("section"), F.col("to_id").alias("other_id"), "seq"))
            entry = impact.two_hop_entrypoints(self.edges).join(ids.select(F.col("id").alias("method_id")), "method_id", "left_semi").select(F.lit("entrypoints").alias("section"), F.coalesce("source_id", "handler_id").alias("other_id"), F.lit(0).cast("bigint").alias("seq"))
            return calls.unionByName(entry).orderBy("section", "seq", "other_id").select("section", "other_id").limit(3 * n)
        ids = self._object_ids(name, object_type)
        return impact.context(self.edges, n).join(ids.select("id"), "id", "left_semi").select("section", "other_id").orderBy("section", "other_id")

    def build_implementation_context(self, task: str, limit: int = 5) -> DataFrame:
        """The best objects and methods for a task, with how much depends on them."""
        n = clamp(limit, 20)
        o = self.search_metadata(task, n).select(F.lit("metadata").alias("target"), F.concat(F.lit("metadata:"), "object_type", F.lit("."), "object_name").alias("id"), "score")
        m = self.search_code(task, n).select(F.lit("code").alias("target"), F.concat(F.lit("method:"), "module_path", F.lit("."), "method_name", F.lit(":"), "start_line").alias("id"), "score")
        c = impact.impact_counts(self.edges).select("id", "callers", "callees", "entrypoints")
        d = self.edges.filter(F.col("edge_type").isin("references_metadata", "uses_metadata")).groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
        return o.unionByName(m).join(c, "id", "left").join(d, "id", "left").na.fill(0, ["callers", "callees", "entrypoints", "uses"])

    def analyze_task(self, task: str, limit: int = 5) -> DataFrame:
        """Evidence for a task, the configurations in scope, and risks: section, label, detail."""
        e = self.build_implementation_context(task, limit)
        rows = e.select(F.lit("evidence").alias("section"), F.col("id").alias("label"), F.concat(F.lit("score "), F.round("score", 3)).alias("detail"))
        c = self.tables["configs"].filter((F.col("config_id") == self.config_id) | (F.col("base_config_id") == self.config_id))
        rows = rows.unionByName(c.select(F.lit("scope").alias("section"), F.col("config_id").alias("label"), F.concat_ws(" ", "config_kind", "base_config_id").alias("detail")))
        for name, cond in (("many_callers", F.col("callers") >= 5), ("widely_used", F.col("uses") >= 10), ("user_interface", F.col("entrypoints") > 0)):
            rows = rows.unionByName(e.filter(cond).select(F.lit("risk").alias("section"), F.col("id").alias("label"), F.lit(name).alias("detail")))
        return rows

    def trace_business_flow(self, query: str, limit: int = 5, neighbours: int = 10) -> DataFrame:
        """The best objects and methods for a question and their neighbours, the first `neighbours` of each section:
        start_id, section, other_id."""
        ids = self.build_implementation_context(query, limit).select(F.col("id"))
        flow = impact.context(self.edges, neighbours).join(ids, "id", "left_semi").select(F.col("id").alias("start_id"), "section", "other_id")
        calls = self.edges.filter("edge_type = 'calls'").join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("from_id").alias("start_id"), F.lit("callees").alias("section"), F.col("to_id").alias("other_id"))
        return flow.unionByName(calls).distinct()

    def extension_overlay_report(self) -> DataFrame:
        """This extension, or all extensions of this configuration, against their base."""
        mine = (F.col("config_id") == self.config_id) | (F.col("base_config_id") == self.config_id)
        c = self.tables["configs"].filter(mine & F.col("base_config_id").isNotNull())
        n = self.tables["nodes"].drop("recorded_at", "deleted_at")
        return impact.overlay_report(impact.overlay(graph.merge_nodes(n), c))

    def list_configurations(self) -> DataFrame:
        """W12."""
        return self.tables["configs"].distinct().withColumn("active", F.col("config_id") == self.config_id)

    # --- validation and status
    def validate_bsl(self, path: str) -> DataFrame:
        """V4: structure issues of one module."""
        return modules.validate_modules(self.files.filter(exports.slashes(F.col("rel_path")).endswith(path.replace("\\", "/"))))

    def changed(self) -> DataFrame:
        """The newest versions that the last successful run of the configuration's own cache did not note."""
        own = lambda n: self.tables[n].filter(F.col("config_id") == self.config_id)
        todo = pending_files(own("export_files"), own("index_state"), self.tables["configs"], self.tables["index_runs"])
        return self.files.join(todo.select("file_id"), "file_id", "left_semi")

    def validate_changed_files(self, per_file: int = 20) -> DataFrame:
        """V5: issues of changed modules, the first of each file."""
        from pyspark.sql import Window

        issues = modules.validate_modules(self.changed())
        return issues.withColumn("_n", F.row_number().over(Window.partitionBy("rel_path").orderBy("line", "message"))).filter(F.col("_n") <= clamp(per_file, 200)).drop("_n")

    def _fresh(self, changed: DataFrame) -> DataFrame:
        built = self._own("index_runs").filter("run_status = 'success'").select("config_id", F.col("finished_at").alias("built_at"))
        noted = state_rows(self._own("index_state"), self.tables["configs"], self.tables["index_runs"]).filter("run_status = 'success'")
        noted = noted.select("config_id", "rel_path", F.col("noted_mtime").alias("mtime"), "written_at")
        return impact.freshness(changed.select("config_id", exports.slashes(F.col("rel_path")).alias("rel_path"), "mtime"), noted, built)

    def post_change_report(self, server: bool | None = None) -> DataFrame:
        """V8. server: whether a language server that was asked came to its end; None if none was asked."""
        c = self.changed()
        issues = modules.validate_modules(c).join(c.select("file_id", "file_path"), "file_id").select("file_path", "severity")
        v = impact.batch_validation(c, self.tables["diagnostics"].distinct(), issues, server)
        ids = self.nodes_of("method").join(c.select("file_path").distinct(), "file_path", "left_semi").select("config_id", "id")
        return impact.post_change_status(v, impact.impact_counts(self.edges, ids), self._fresh(c), c, self.nodes, server)

    def bsl_ls_status(self, settings: dict | None = None) -> dict:
        """V9: whether a language server is there; it is not needed for anything else."""
        return language_server.server_status(settings)

    def analyze_with_server(self, paths: list[str], settings: dict | None = None) -> tuple[str, DataFrame]:
        """V2, V3: the language server's status and its findings in a few modules, at most 200."""
        if len(paths) > 200:
            raise ValueError("at most 200 modules in one request")
        hit = self.files.filter(exports.slashes(F.col("rel_path")).isin(*[x.replace("\\", "/") for x in paths])).select("rel_path", "content").collect()
        done = language_server.analyze({r["rel_path"]: bytes(r["content"]) for r in hit}, settings)
        return done.status, modules.report_diagnostics(self.spark.createDataFrame([(done.report,)] if done.report else [], "report string"))

    def embedding_status(self) -> dict:
        """V10."""
        n = self.embeddings.select(F.size("embedding").alias("n")).head(1) if self.embeddings is not None else []
        return {"ready": bool(n), "size": n[0]["n"] if n else 0, "embedder": getattr(self.embedder, "__name__", str(self.embedder))}

    def index_status(self) -> DataFrame:
        """Section, name, n of chunks by type, graph parts and files."""
        c = self.tables["chunks"].filter(F.col("config_id") == self.config_id).select("id", "chunk_type").distinct().groupBy(F.col("chunk_type").alias("name")).count().select(F.lit("chunks").alias("section"), "name", F.col("count").alias("n"))
        g = graph.graph_stats(self.nodes, self.edges).select("part", "name", "n").withColumnRenamed("part", "section")
        f = exports.export_counts(self.files, self._own("index_state")).selectExpr("stack(6, 'files', files, 'bsl', bsl, 'xml', xml, 'form_xml', form_xml, 'unknown', unknown, 'changed', changed) as (name, n)").withColumn("section", F.lit("files"))
        return c.unionByName(g).unionByName(f.select("section", "name", "n"))

    def reindex_path(self, store: TableStore, path: str = "", rebuild_graph: bool = True) -> dict:
        """Replaces the methods of the files at or below a path in the store, with the note of their versions, and the
        configuration's graph. A file that has no methods any more has none in the store."""
        p = path.replace("\\", "/").strip("/")
        rel = exports.slashes(F.col("rel_path"))
        hit = self.files.filter((F.lit(p) == "") | (rel == p) | rel.startswith(p + "/"))
        m = modules.methods(hit).withColumn("file_path", rel)
        version = store.replace_versions("methods", m, hit.select("config_id", rel.alias("file_path"), "scanned_at", "file_id"))
        if rebuild_graph:
            n, e = graph.build_graph(descriptors.objects(self.files), descriptors.forms(self.files), modules.methods(self.files), modules.modules(self.files))
            write_graph(store, n.drop("node_seq"), e.drop("seq"), self.config_id)
        return {"version": version, "files": hit.count()}

    def reindex_file(self, store: TableStore, path: str, rebuild_graph: bool = True) -> dict:
        """V12 for one file."""
        return self.reindex_path(store, path, rebuild_graph)


def question_columns(texts: DataFrame, column: str) -> list[Column]:
    """Q6: the intents of each text as columns."""
    n, k = t.normalize_col(F.col(column)), t.keywords_col(F.col(column))
    from metascope.functions.constants import REPORT_PHRASES, STRUCTURE_PHRASES

    return [t.object_type_col(F.col(column)).alias("object_type"), t.contains_any_col(n, STRUCTURE_PHRASES).alias("structural"), t.contains_any_col(n, REPORT_PHRASES).alias("report"), F.size(k).alias("keywords")]
