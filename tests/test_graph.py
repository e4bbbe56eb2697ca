import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from metascope.operators import graph, impact, skew, vectors
from metascope.operators.search import Question, Rule
from metascope.plans import graph_queries
from metascope.plans.engine import Engine
from metascope.sources import descriptors, modules
from metascope.sources.sinks import TableStore, graph_writers, markdown, relation_name, setup_collection, write_graph
from tests_data import CATALOG, FORM, MODULE, files

EDGES = "seq bigint, config_id string, from_id string, to_id string, edge_type string, section string, container string, edge_source string, raw_type string, event string, data_path string"


def edges(spark, rows):
    return spark.createDataFrame([(i, "a", *r, *[None] * (9 - len(r))) for i, r in enumerate(rows)], EDGES)


def test_built_graph(spark):
    form_module = 'Процедура ПриИзменении()\nОбщий.Сделать();\nКонецПроцедуры\nПроцедура Сохранить()\nПриИзменении(); Сохранить();\nКонецПроцедуры'
    f = files(spark, [("Catalogs/Товары.xml", CATALOG.encode()), ("Catalogs/Товары/Forms/Ф/Ext/Form.xml", FORM.encode()), ("Catalogs/Товары/Forms/Ф/Ext/Form/Module.bsl", form_module.encode()), ("CommonModules/Общий/Ext/Module.bsl", "Процедура Сделать() Экспорт\nКонецПроцедуры".encode()), ("Catalogs/Товары/Ext/ObjectModule.bsl", MODULE.encode()), ("broken.xml", b"<x")])
    n, e = graph.build_graph(descriptors.objects(f), descriptors.forms(f), modules.methods(f), modules.modules(f))
    kinds = {r.kind: r["count"] for r in n.groupBy("kind").count().collect()}
    assert kinds == {"metadata": 5, "form": 1, "form_element": 4, "command": 1, "handler": 3, "module": 3, "method": 5}
    stubs = {r.id for r in n.filter("is_stub").collect()}
    assert stubs == {"metadata:Catalog.Виды", "metadata:Document.Приход", "metadata:Enum.Цвета", "metadata:CommonModule.Общий"}
    got = {(r.edge_type, r.from_id.split(":")[-1] if r.edge_type != "calls" else r.from_id, r.to_id) for r in e.collect()}
    types = {r.edge_type: r["count"] for r in e.groupBy("edge_type").count().collect()}
    assert types["contains_form"] == 1 and types["has_form_module"] == 1 and types["invokes_command"] == 1 and types["contains_child_element"] == 2 and types["contains_element"] == 2 and types["handled_by"] == 1 and types["uses_metadata"] == 1
    assert types["calls"] == 4 and types["implements_handler"] >= 2 and types["references_metadata"] == 3 and types["declares_method"] == 5
    assert not any(a == b for t, a, b in got if t == "calls"), "no method calls itself"


def test_merging(spark):
    rows = [("a", "n", "metadata", 1, "old", "", None, None), ("a", "n", "metadata", 2, None, "x", None, True), ("a", "n", "module", 3, "", None, None, None), ("a", "s", "metadata", 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "config_id string, id string, kind string, node_seq int, object_name string, synonym string, file_path string, is_stub boolean")
    out = {r.id: r for r in graph.merge_nodes(df).collect()}
    assert (out["n"].object_name, out["n"].synonym, out["n"].kind, out["n"].is_stub, out["s"].is_stub) == ("old", "x", "module", False, True)
    e = edges(spark, [("x", "y", "t", None, "", "s"), ("x", "y", "t", "", None, "s", "raw"), ("x", "y", "t", "", None, "other")])
    assert sorted(r.seq for r in graph.dedupe_edges(e).collect()) == [0, 2]


def test_long_neighbour_lists_are_whole(spark, tmp_path):
    e = edges(spark, [(f"n{i}", "hub", "t") for i in range(300)] + [("n0", "hub", "u"), (None, "hub", "t"), ("n0", None, "t")])
    rows = [r for r in graph.adjacency(e, most=20).collect() if r.id == "hub"]
    parts = [r.neighbours.split("|") for r in rows]
    assert len(rows) > 1 and len({r.block for r in rows}) == len(rows) and {r.degree for r in rows} == {302}
    assert sorted(x for p in parts for x in p) == sorted(f"n{i}" for i in range(300)) and max(map(len, parts)) <= 40
    e.write.parquet(str(tmp_path / "edges.parquet"))
    got = {r.id: r for r in graph_queries.adjacency(spark, str(tmp_path)).collect() if r.direction == "incoming"}
    assert got["hub"].degree == 302 and got["hub"].neighbours == "|".join(sorted(f"n{i}" for i in range(300)))


def test_resolution_to_the_only_other(spark):
    calls = spark.createDataFrame([("c1", "k", "s"), ("c2", "k", "a"), ("c3", "two", "s"), ("c4", "three", "t1"), ("c5", "none", "s"), ("c6", "self", "z")], "c string, k string, source_id string")
    targets = spark.createDataFrame([("k", "a"), ("two", "a"), ("two", "b"), ("three", "t1"), ("three", "t2"), ("self", "z")], "k string, target_id string")
    assert {(r.c, r.target_id) for r in graph.unique_resolution(calls, targets, ["k"]).collect()} == {("c1", "a"), ("c4", "t2")}


def test_tree_with_a_cycle(spark):
    e = edges(spark, [("a", "b", "contains_child_element"), ("b", "c", "contains_child_element"), ("c", "a", "contains_child_element"), ("a", "c", "contains_child_element")])
    top = spark.createDataFrame([("a", "a")], "config_id string, id string")
    assert {(r.id, r.depth) for r in graph.element_tree(e, top).collect()} == {("a", 0), ("b", 1), ("c", 1)}


def test_tree_is_never_cut_silently(spark):
    e = edges(spark, [(f"n{i}", f"n{i + 1}", "contains_child_element") for i in range(5)])
    top = spark.createDataFrame([("a", "n0")], "config_id string, id string")
    assert sorted(r.depth for r in graph.element_tree(e, top).collect()) == list(range(6)) == sorted(r.depth for r in graph.element_tree(e, top, most_levels=6).collect())
    with pytest.raises(ValueError):
        graph.element_tree(e, top, most_levels=3)


def test_hot_neighbours_are_salted(spark, monkeypatch):
    monkeypatch.setattr("metascope.operators.skew.hot_keys.__defaults__", (10,))
    n = spark.createDataFrame([("a", "hub", "metadata", "f", "Hub")], "config_id string, id string, kind string, file_path string, object_name string").withColumns({c: F.lit(None).cast("string") for c in ("form_name", "module_path", "method_name", "command_name", "handler_name", "element_name")})
    e = edges(spark, [(f"x{i}", "hub" if i % 2 else "gone", "calls") for i in range(100)])
    rows = graph.neighbours(e, n).collect()
    assert len(rows) == 100 and sum(r.n_name == "Hub" for r in rows) == 50
    with pytest.raises(ValueError):
        graph.neighbours(e, n, "both")
    assert skew.hot_keys(e, ["to_id"], 10).count() == 2


def test_impact(spark):
    e = edges(spark, [("m1", "m2", "calls"), ("m3", "m2", "calls"), ("m3", "m2", "calls"), ("h", "m2", "implements_handler"), ("el", "h", "handles_event"), ("cmd", "h", "handled_by")])
    assert {tuple(r)[1:] for r in impact.impact_counts(e).collect()} == {("m2", 2, 0, 1), ("m1", 0, 1, 0), ("m3", 0, 1, 0)}
    assert [tuple(r)[1:] for r in impact.two_hop_entrypoints(e).collect()] == [("m2", "h", "el")]
    cur = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9), (None, 8)], "k string, v int")
    assert sorted(r.v for r in impact.upsert(cur, new, ["k"]).collect()) == [8, 9]


def test_overlay(spark):
    cols = "config_id string, id string, kind string, module_path string, method_name string, extension_target_method string, extension_annotation string, file_path string, object_type string, object_name string, owner_name string, form_name string"
    m = lambda c, i, path, name, target=None, note=None: (c, i, "method", path, name, target, note, "f", None, None, None, None)
    n = spark.createDataFrame([m("base", "1", "M", "A"), m("base", "2", "N", "B"), m("base", "3", "O", "C"), m("base", "4", "P", "C"), m("ext", "5", "M", "Р_A", "A", "after"), m("ext", "6", "M", "Р_B", "B", "after"), m("ext", "7", "M", "Р_C", "C", "before"), m("ext", "8", "M", "Р_D", "D", "before"), m("ext", "9", "M", "new")], cols)
    c = spark.createDataFrame([("base", None), ("ext", "base")], "config_id string, base_config_id string")
    rows = {r.id: (r.in_base, r.reason) for r in impact.overlay(n, c).collect()}
    assert rows == {"5": (True, None), "6": (False, "target_found_in_other_module"), "7": (False, "target_name_ambiguous_outside_expected_module"), "8": (False, "target_absent_in_base_graph"), "9": (False, None)}
    assert tuple(impact.overlay_report(impact.overlay(n, c)).first())[3:] == (5, 1, 4, 1, 3)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (5, x[5].tolist()), (301, [0.0] * 16)], "vec_id bigint, embedding array<float>")
    q = df.filter("vec_id % 50 = 0")
    exact = vectors.topk(df, q, 5)
    u = np.vstack([x, np.zeros((2, 16))]).astype("float64")
    u = np.divide(u, np.linalg.norm(u, axis=1, keepdims=True), out=np.zeros_like(u), where=np.linalg.norm(u, axis=1, keepdims=True) > 0)
    got = {}
    for r in exact.collect():
        got.setdefault(r.query_id, []).append((r.place, r.id))
    for i, rows in got.items():
        s = np.round(u @ u[i], 5)
        want = sorted((j for j in range(302) if j != 300), key=lambda j: (-s[j], j))[:5]
        assert [j for _, j in sorted(rows)] == want
    index = vectors.VectorIndex.fit(df)
    assert vectors.recall(index.search(df, q, 5), exact).first().recall >= 0.9
    best = {r.id: (r.score, r.query_id) for r in vectors.best_per_key(exact).collect()}
    assert best[0] == (1.0, 0)
    empty = df.filter("false")
    assert vectors.topk(empty, q, 3).count() == 0 and vectors.VectorIndex.fit(empty).search(empty, q, 3).count() == 0


def test_fusion_keeps_the_first_of_equals(spark):
    a = spark.createDataFrame([("k", 1.0), ("l", 3.0)], "key string, score double")
    b = spark.createDataFrame([("k", 1.0), ("l", 4.0), ("m", 0.5)], "key string, score double")
    got = {r.key: (r.score, r.source, r.sources) for r in vectors.fuse({"one": a, "two": b}, ["key"]).collect()}
    assert got == {"k": (1.0, "one", ["one", "two"]), "l": (4.0, "two", ["one", "two"]), "m": (0.5, "two", ["two"])}


def test_questions_and_rules():
    rule = Rule("receipt", ("поступлен", "товар"), ("приход",), ("Document",), ("приходная накладная",))
    q = Question("документ поступления товаров", (rule,))
    assert q.kind == "Document" and q.active == (rule,) and "приходная накладная" in q.retrieval()
    assert Question("остатки", (rule,)).active == ()


def test_stores(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    n = spark.createDataFrame([("a", "1", "method", "text"), ("b", "2", "form", None)], "config_id string, id string, kind string, document string")
    e = edges(spark, [("1", "2", "calls it!")])
    write_graph(store, n.filter("config_id = 'a'"), e, "a")
    write_graph(store, n.filter("config_id = 'b'"), e.withColumn("config_id", F.lit("b")), "b", structural=True)
    write_graph(store, n.filter("config_id = 'a'"), e, "a")
    assert store.read("nodes").count() == 2 and store.read("edges").select("relation").distinct().first()[0] == "CALLSIT" and store.read("none") is None
    assert spark.range(1).select(relation_name(F.lit("--"))).first()[0] == "RELATED_TO"
    assert setup_collection(spark, store, 64) and len(graph_writers("json, table")) == 2
    for w in graph_writers("json structural"):
        w(store, n, e, "a")
    with pytest.raises(ValueError):
        graph_writers("other")
    assert "| 1 |" in markdown(n, "t") and "Nothing" in markdown(n.filter("false"), "t")


def test_engine(spark, data, tmp_path):
    first = spark.read.parquet(f"{data}/nodes.parquet").filter("kind = 'method'").groupBy("config_id").count().orderBy(F.desc("count")).first().config_id
    e = Engine.open(spark, data, first)
    name = e.nodes_of("metadata").filter("object_name is not null").orderBy("object_name").first()
    hit = e.find_metadata_object(name.object_name, name.object_type, 1).first()
    assert (hit.object_type, hit.object_name) == (name.object_type, name.object_name) and hit.score > 900
    method = e.code.filter("method_name is not null").orderBy("id").first()
    assert e.find_method(method.method_name, limit=1).first().method_name.lower() == method.method_name.lower()
    assert e.search_metadata(name.object_name, 3).first().object_name == name.object_name
    assert e.index_status().filter("section = 'chunks'").count() > 0 and e.post_change_report().count() == 1
    assert e.bsl_ls_status({"BSL_LS_BINARY": "no-such-binary"})["status"] == "unavailable" and not e.embedding_status()["ready"]
    with pytest.raises(KeyError):
        e.for_config("none")
    store = TableStore(spark, str(tmp_path))
    assert e.reindex_path(store)["files"] > 0 and store.read("edges").count() > 0
    assert e.for_config(first).list_configurations().filter("active").count() == 1


def test_streaming_ingest(spark, data, tmp_path):
    from metascope.streaming.ingest import change_counts, ingest_methods

    src = spark.read.parquet(f"{data}/export_files.parquet")
    src.write.parquet(str(tmp_path / "in"))
    store = TableStore(spark, str(tmp_path / "out"))
    for _ in range(2):
        ingest_methods(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination(100)
    assert store.read("methods").count() > 0 and len({r.rel_path for r in store.read("methods").select("rel_path").distinct().collect()}) > 0
    assert change_counts(spark, str(tmp_path / "in")).isStreaming and timedelta(days=1)


VERSIONS = "file_id bigint, config_id string, file_path string, rel_path string, mtime timestamp_ntz, length bigint, content binary, scanned_at timestamp_ntz"


def versions(spark, *rows):
    """(file_id, rel_path, day of scanned_at, content)"""
    return spark.createDataFrame([(i, "a", p, p, None, len(c), c.encode(), datetime(2025, 1, 1) + timedelta(days=d)) for i, p, d, c in rows], VERSIONS).coalesce(1)


def test_ingest_takes_the_newest_of_all_batches(spark, tmp_path):
    from metascope.streaming.ingest import ingest_methods

    method = lambda n: f"Процедура {n}()\nКонецПроцедуры\n"
    store = TableStore(spark, str(tmp_path / "out"))
    steps = [
        ([(1, "A/x.bsl", 5, method("П5")), (2, "A/y.bsl", 5, method("У5"))], ["П5", "У5"]),
        ([(3, "A/x.bsl", 4, method("П4")), (4, "A\\x.bsl", 3, method("П3"))], ["П5", "У5"]),  # older ones come later
        ([(5, "A/y.bsl", 6, "// пусто"), (6, "A/x.bsl", 5, method("П5а"))], ["П5а"]),  # no methods; a tie goes to the greater file_id
        ([(7, "A/y.bsl", 5, method("У5"))], ["П5а"]),  # what was cleared stays so
        ([(8, "A/x.bsl", 7, "")], []),
        ([(9, "A/y.bsl", 8, method("У8"))], ["У8"]),
    ]
    for rows, names in steps:
        versions(spark, *rows).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_methods(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination(100)
        assert sorted(r.method_name for r in store.read("methods").collect()) == names


def test_reindex_clears_files_without_methods(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    for n, content in enumerate(["Процедура П()\nКонецПроцедуры", "// пусто"]):
        e = Engine.__new__(Engine)
        e.__dict__.update(config_id="a", files=versions(spark, (n, "A/x.bsl", n, content)))
        e.reindex_path(store, rebuild_graph=False)
        assert store.read("methods").count() == 1 - n


def test_snippets_of_contents_that_are_not_utf8(spark):
    contents = ["\ufeffА\r\nБ\ufffd\rВ".encode(), b"x\xff\xd0y\n\xd0\x90\xd0", b"\x89PNG\r\n\x1a", None]  # byte order mark; stray and cut-off bytes; a binary file
    rows = [(i, "a", f"D:/{i}/x.bsl", f"{i}\\x.bsl", None, None, c, datetime(2025, 1, 1)) for i, c in enumerate(contents)]
    e = Engine(spark, {"export_files": spark.createDataFrame(rows, VERSIONS)}, "a")
    got = sorted(map(tuple, e.get_file_snippet("x.bsl", 1, 2).collect()))
    assert got == [("0\\x.bsl", 1, "А"), ("0\\x.bsl", 2, "Б\ufffd"), ("1\\x.bsl", 1, "xy"), ("1\\x.bsl", 2, "А"), ("2\\x.bsl", 1, "PNG"), ("2\\x.bsl", 2, "\x1a")]


def test_late_versions_are_counted(spark, tmp_path):
    from metascope.streaming.ingest import change_counts

    got = {}

    def keep(df, _):
        got.update({r.window.start.day: (r.versions, r.bytes) for r in df.collect()})

    for rows in ([(1, "x", 9, "a"), (2, "y", 9, "bb")], [(3, "x", 9, "c")], [(4, "x", 1, "ddd"), (5, "y", 9, "e")]):
        versions(spark, *rows).write.mode("append").parquet(str(tmp_path / "in"))
        change_counts(spark, str(tmp_path / "in")).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(100)
    assert got == {10: (4, 5), 2: (1, 3)}
