"""Sinks: the graph and the chunks as tables of commits, each an atomic rename; a JSON graph; a graph database; reports."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metascope.operators.graph import graph_stats
from metascope.sources.deltas import DeltaLog


def relation_name(edge_type: Column) -> Column:
    """K4: an edge type in upper case, of letters, digits and underscores; RELATED_TO if nothing is left."""
    name = F.regexp_replace(F.upper(F.coalesce(edge_type, F.lit(""))), r"[^\p{L}\p{N}_]", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("RELATED_TO"))


class TableStore:
    """Tables in a folder that all executors share, each a DeltaLog by (config_id, file_path): replacing a file or a
    configuration writes its rows and a note of what they replace, not the table. A commit becomes the current version
    when it is renamed onto its number; readers see the version before until then, and a failed write leaves it. Rows lie
    sorted by configuration, so that a scan of one skips most row groups."""

    KEYS = ["config_id", "file_path"]

    def __init__(self, spark: SparkSession, folder: str, every: int = 16):
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), every

    def _log(self, table: str) -> DeltaLog:
        return DeltaLog(self.spark, f"{self.folder}/{table}", self.KEYS, self.every)

    def current(self, table: str) -> int:
        """The version that holds; 0 before the first."""
        return self._log(table).version()

    def read(self, table: str) -> DataFrame | None:
        return self._log(table).read()

    @staticmethod
    def _sorted(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions("config_id") if "config_id" in df.columns else df

    def write(self, table: str, df: DataFrame) -> int:
        """The whole table anew."""
        return self._log(table).commit(lambda old, v: (self._sorted(df), df), 0)

    def replace_configuration(self, table: str, df: DataFrame, config_id: str) -> int:
        """K2: the rows of one configuration replaced."""
        key = self.spark.createDataFrame([(config_id,)], "config_id string")
        return self._log(table).commit(lambda old, v: (df, key), 1)

    def replace_files(self, table: str, df: DataFrame, files: DataFrame | None = None) -> int:
        """K7: all rows of the given files (config_id, file_path) replaced; without `files`, of those in df. A given file that
        has no rows in df has none afterwards."""
        return self._log(table).commit(lambda old, v: (self._sorted(df), files))

    def newer_files(self, table: str, files: DataFrame) -> DataFrame:
        """Those of the files (config_id, file_path, scanned_at, file_id) that are newer than what replace_versions put into
        the table: a greater scanned_at, ties: file_id."""
        old = self.read(f"{table}_files")
        if old is None:
            return files
        o = old.select(F.col("config_id").alias("_c"), F.col("file_path").alias("_p"), F.struct("scanned_at", "file_id").alias("_v"))
        same = F.col("config_id").eqNullSafe(F.col("_c")) & F.col("file_path").eqNullSafe(F.col("_p"))
        return files.join(o, same & (F.struct("scanned_at", "file_id") <= F.col("_v")), "left_anti")

    def replace_versions(self, table: str, df: DataFrame, files: DataFrame) -> int:
        """replace_files, and then a note of the files' versions in <table>_files: a failure between the two leaves the older
        note, so that the repeated step replaces the same files again."""
        v = self.replace_files(table, df, files)
        self.replace_files(f"{table}_files", files)
        return v


def write_graph(store: TableStore, nodes: DataFrame, edges: DataFrame, config_id: str, structural: bool = False) -> None:
    """K2, K3: nodes by kind, edges by type and the projection's statistics of one configuration. The structural graph has
    no documents."""
    n = nodes.drop("document") if structural else nodes
    store.replace_configuration("nodes", n, config_id)
    store.replace_configuration("edges", edges.withColumn("relation", relation_name(F.col("edge_type"))), config_id)
    store.replace_configuration("projection_stats", graph_stats(nodes, edges), config_id)


def write_json_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """K1: the graph as JSON lines, nodes and edges apart, null attributes left out. It is written aside and then renamed to
    its place; a failure before that leaves the old graph, and one between the two renames puts it back."""
    spark, folder = nodes.sparkSession, folder.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = f"{folder}._new-{uuid.uuid4().hex}", f"{folder}._old-{uuid.uuid4().hex}"
    try:
        nodes.write.json(f"{new}/nodes")
        edges.write.json(f"{new}/edges")
        had = fs.exists(path(folder))
        if had and not fs.rename(path(folder), path(old)):
            raise RuntimeError(f"{folder} could not be set aside")
        if not fs.rename(path(new), path(folder)):
            if had:
                fs.rename(path(old), path(folder))
            raise RuntimeError(f"{folder} could not be committed")
        if had:
            fs.delete(path(old), True)
    finally:
        fs.delete(path(new), True)


def retried(step: Callable[[], None], tries: int = 3, wait: float = 1.0) -> None:
    """K5: a step that may be repeated, up to `tries` times, each wait twice as long as the one before."""
    for n in range(tries):
        try:
            return step()
        except Exception:
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)


#: K2: what a graph database is sent; each statement gets a batch of rows and may be repeated.
NODE_STATEMENT = "UNWIND $rows AS row MERGE (n:Node {{config_id: row.config_id, id: row.id}}) SET n:{label} SET n += row"
EDGE_STATEMENT = "UNWIND $rows AS row MATCH (a:Node {{config_id: row.config_id, id: row.from_id}}) MATCH (b:Node {{config_id: row.config_id, id: row.to_id}}) MERGE (a)-[r:{label}]->(b) SET r += row"
INDEX_STATEMENTS = ("CREATE INDEX ON :Node(id)", "CREATE INDEX ON :Node(config_id)")
CLEAR_STATEMENT = "MATCH (n:Node {config_id: $config_id}) DETACH DELETE n"


def write_graph_database(nodes: DataFrame, edges: DataFrame, config_id: str, connect: Callable[[], object], batch: int = 500, tries: int = 3, parallel: int = 4) -> None:
    """K2: one configuration's graph into a graph database. connect() gives, on the driver and in each task, an object with
    run(statement, parameters) and close(). The configuration is cleared first, then nodes, then edges are merged in batches by
    label, at most `parallel` tasks at once; a failed batch is repeated, and merging makes repeated tasks harmless."""

    def once(statement: str, parameters: dict) -> None:
        db = connect()
        try:
            retried(lambda: db.run(statement, parameters), tries)
        finally:
            db.close()

    def send(df: DataFrame, statement: str, label: Column) -> None:
        names = df.columns

        def run(rows: Iterable) -> None:
            db, kept = connect(), {}
            try:
                for r in rows:
                    part = kept.setdefault(r["_label"], [])
                    part.append({c: r[c] for c in names if r[c] is not None})
                    if len(part) >= batch:
                        retried(lambda: db.run(statement.format(label=r["_label"]), {"rows": part}), tries)  # noqa: B023
                        kept[r["_label"]] = []
                for name, part in kept.items():
                    if part:
                        retried(lambda: db.run(statement.format(label=name), {"rows": part}), tries)  # noqa: B023
            finally:
                db.close()

        df.withColumn("_label", label).repartition(parallel).foreachPartition(run)

    for s in INDEX_STATEMENTS:
        once(s, {})
    once(CLEAR_STATEMENT, {"config_id": config_id})
    send(nodes, NODE_STATEMENT, relation_name(F.col("kind")))
    send(edges, EDGE_STATEMENT, relation_name(F.col("edge_type")))


#: K6: what can be written, by name.
WRITERS = {"json": lambda store, n, e, c: write_json_graph(n, e, f"{store.folder}/json/{c}"), "table": lambda store, n, e, c: write_graph(store, n, e, c), "structural": lambda store, n, e, c: write_graph(store, n, e, c, True)}


def graph_writers(targets: str) -> list:
    """The writers of a list such as `json, table`; an unknown name raises ValueError."""
    names = [x for x in re.split(r"[\s,;]+", targets.strip().lower()) if x]
    unknown = [x for x in names if x not in WRITERS]
    if unknown:
        raise ValueError(f"unknown graph writers: {', '.join(unknown)}")
    return [(lambda *a, w=WRITERS[x]: retried(lambda: w(*a))) for x in names]


def setup_collection(spark: SparkSession, store: TableStore, size: int) -> bool:
    """K8: makes the table of points if there is none, anew if its vectors have another length; whether it was made."""
    old = store.read("points")
    row = old.select(F.size("embedding").alias("n")).head(1) if old is not None else []
    if old is not None and (not row or row[0]["n"] == size):
        return False
    store.write("points", spark.createDataFrame([], "id string, config_id string, chunk_type string, file_path string, embedding array<float>, document string"))
    return True


def markdown(df: DataFrame, title: str, limit: int = 50) -> str:
    """K9: the first rows of a result as a Markdown table, for people; a limit is what such a report is for."""
    rows, cols = df.limit(limit).collect(), df.columns
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"## {title}", "", "| " + " | ".join(cols) + " |", "|" + "-|" * len(cols), *("| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows)] if rows else [f"## {title}", "", "Nothing was found."])
