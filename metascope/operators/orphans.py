"""References to records that do not exist: a fixpoint cascade down the foreign-key graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metascope.operators.skew import hot_keys, salted_join
from metascope.runtime import clean_key, cut

#: Edges that make their target part of their source: with the source gone, the target hangs in the air.
OWNERSHIP = ("contains_form", "contains_module", "contains_command", "contains_element", "contains_child_element", "declares_method", "has_form_module")
_FIRST, _FAR = "timestamp_ntz '0001-01-01 00:00:00'", "timestamp_ntz '9999-12-31 23:59:59'"
_PARTS = 32


def _heirs(configs: DataFrame) -> DataFrame:
    """(_base, _heirs): the configurations that see the records of another one; a row for each registered base."""
    pairs = configs.select("config_id", "base_config_id").filter("config_id is not null and base_config_id is not null and config_id <> base_config_id")
    return pairs.groupBy(F.col("base_config_id").alias("_base")).agg(F.collect_set("config_id").alias("_heirs"))


def _scopes(df: DataFrame, heirs: DataFrame) -> DataFrame:
    """`df` with _scopes: the configurations from which a row can be seen, its own and its heirs."""
    return df.join(heirs, df.config_id == heirs._base, "left").drop("_base").withColumn("_scopes", F.array_union(F.array("config_id"), F.coalesce("_heirs", F.expr("cast(array() as array<string>)")))).drop("_heirs")


def nodes_in_force(nodes: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, key, since, until): the spans in which a real node can be seen from a configuration, its own nodes
    and those of its base_config_id. Rows with is_stub true, without id or without recorded_at give no span; repeated
    rows collapse."""
    real = nodes.filter(~F.coalesce(F.col("is_stub"), F.lit(False))).select("config_id", clean_key(F.col("id")).alias("key"), F.col("recorded_at").alias("since"), F.coalesce("deleted_at", F.expr(_FAR)).alias("until"))
    real = real.filter("config_id is not null and key is not null and since is not null and since < until")
    seen = _scopes(real, _heirs(configs)).select(F.explode("_scopes").alias("config_id"), "key", "since", "until")
    return seen.groupBy("config_id", "key", "since").agg(F.max("until").alias("until"))


def gaps(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """(config_id, key, since, until): the times in which the wanted (config_id, key) have no span; all times for a key that
    has none. Spans within an earlier one are left out in parts of each key first, so that a key with many spans is
    not sorted in one task."""
    mine = spans.join(wanted, ["config_id", "key"], "left_semi").withColumn("_part", F.pmod(F.xxhash64("since"), F.lit(_PARTS)))
    before = lambda *by: F.max("until").over(Window.partitionBy("config_id", "key", *by).orderBy("since").rowsBetween(Window.unboundedPreceding, -1))
    mine = mine.withColumn("_before", before("_part")).filter("_before is null or _before < until").drop("_before", "_part")
    row = lambda df, a, b: df.select("config_id", "key", a.alias("since"), b.alias("until"))
    led = mine.withColumn("_before", before()).filter("_before is null or _before < since")
    out = row(led, F.coalesce("_before", F.expr(_FIRST)), F.col("since"))
    ends = mine.groupBy("config_id", "key").agg(F.max("until").alias("_end"))
    rest = wanted.join(ends, ["config_id", "key"], "left").withColumn("_end", F.coalesce("_end", F.expr(_FIRST))).filter(F.col("_end") < F.expr(_FAR))
    return out.unionByName(row(rest, F.col("_end"), F.expr(_FAR)))


def orphan_edges(edges: DataFrame, nodes: DataFrame, configs: DataFrame, ownership: tuple[str, ...] = OWNERSHIP, cascade: bool = True) -> DataFrame:
    """Every edge that refers to a record that is not there, or that hangs on one, once for each seq.

    Out: seq, config_id, from_key, to_key, edge_type, observed_at, orphan_kind, depth, owner_depth.

    direct (depth 0): to_id is not null or blank, and no real node of that id (without outer blanks and letter case) is
    in force at observed_at in the edge's configuration or its base. A null config_id or observed_at matches no node, so
    such an edge is direct. inherited: not direct, and the last of a chain of ownership edges, each starting where the one
    before ends, whose first starts at a record that is missing, all observed within one and the same gap of that
    record (a time in which no real node of it is in force). depth is the length of the shortest such chain. A chain is
    judged from one configuration: with its own edges and nodes and those of its base. owner_depth tells the same of
    direct edges: the shortest chain that ends with them, null where there is none. Cycles end, since a record
    enters once with each gap. An edge without observed_at is in no chain. Other columns are ignored; empty tables give no
    rows (without nodes every named target is missing).

    Scale: targets and owners are asked in one anti-join on (config_id, key), hot keys salted. Each round reads the
    ownership edges only, in a semi-join-like step against the ids that the last round lost; the optimizer broadcasts these where their
    written table is under its size threshold.
    """
    cols = ["seq", "config_id", "from_key", "to_key", "edge_type", "observed_at"]
    keys = F.array(F.struct(clean_key(F.col("from_id")).alias("from_key"), clean_key(F.col("to_id")).alias("to_key")))  # out of a generator, so that filters don't bring the cleaning in again
    e = edges.filter("to_id is not null").select("seq", "config_id", "edge_type", "observed_at", F.explode(keys).alias("k")).select("seq", "config_id", "k.from_key", "k.to_key", "edge_type", "observed_at")
    owns = F.coalesce(F.col("edge_type").isin(*ownership), F.lit(False)) & F.col("from_key").isNotNull() & F.col("observed_at").isNotNull()
    target = F.array(F.struct(F.col("config_id").alias("scope"), F.col("to_key").alias("key"), F.lit(True).alias("target")))
    if cascade:
        e = _scopes(e, _heirs(configs))
        owners = F.transform("_scopes", lambda s: F.struct(s.alias("scope"), F.col("from_key").alias("key"), F.lit(False).alias("target")))
        target = F.when(owns, F.concat(target, owners)).otherwise(target)
    asked = e.select(*cols, F.explode(target).alias("a")).select(*cols, "a.scope", "a.key", "a.target").filter("to_key is not null")
    spans = cut(nodes_in_force(nodes, configs))
    in_force = (F.col("since") <= F.col("observed_at")) & (F.col("observed_at") < F.col("until"))
    seen = spans.withColumnsRenamed({"config_id": "scope"})
    missing = cut(salted_join(asked, seen, ["scope", "key"], "left_anti", in_force, hot_keys(asked, ["scope", "key"])))
    found = missing.filter("target").select(*cols, F.lit(True).alias("direct"), F.lit(None).cast("int").alias("level"))
    lost = missing.filter("not target").select(*cols, "scope", "key")
    if cascade and not lost.isEmpty():
        gap = gaps(spans, lost.select(F.col("scope").alias("config_id"), "key").distinct()).withColumnsRenamed({"config_id": "scope"})
        owned = cut(e.filter(owns & F.col("to_key").isNotNull()).select(*cols, F.explode("_scopes").alias("scope")))
        place = ["scope", "to_key", "since", "until"]
        level, known, depth = cut(lost.join(gap, ["scope", "key"]).filter(in_force).select(*cols, "scope", "since", "until").distinct()), None, 1
        while not level.isEmpty():
            mine = level.filter(F.col("scope").eqNullSafe(F.col("config_id")))
            found = found.unionByName(mine.select(*cols, F.lit(False).alias("direct"), F.lit(depth).alias("level")))
            front = level.select(*place).distinct()
            if known is not None:
                front = front.join(known, place, "left_anti")
            known = front if known is None else known.unionByName(level.select(*place))
            known = cut(known.distinct()) if depth % 16 == 0 else known
            front = front.withColumnsRenamed({"scope": "_scope", "to_key": "_key"})
            level = cut(owned.join(front, (owned.scope == front._scope) & (owned.from_key == front._key)).filter(in_force).select(*cols, "scope", "since", "until").distinct())
            depth += 1
    out = found.groupBy(*cols).agg(F.bool_or("direct").alias("_direct"), F.min("level").alias("owner_depth"))
    return out.select(*cols, F.when(F.col("_direct"), "direct").otherwise("inherited").alias("orphan_kind"), F.when(F.col("_direct"), 0).otherwise(F.col("owner_depth")).alias("depth"), "owner_depth")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per edge_type and month of observed_at: edge_type, month (yyyy-MM), direct, inherited, and of the direct ones
    those whose owner is lost, too."""
    count = lambda test, name: F.count_if(test).alias(name)
    kind = F.col("orphan_kind")
    return orphans.groupBy("edge_type", F.date_format("observed_at", "yyyy-MM").alias("month")).agg(
        count(kind == "direct", "direct"), count(kind == "inherited", "inherited"), count((kind == "direct") & F.col("owner_depth").isNotNull(), "direct_and_inherited")
    )
