"""Processing only new or changed records: a ledger of work items with leases and fencing tokens."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from metascope.sources.deltas import Conflict, DeltaLog

#: retired: pending work that a newer version of the file has taken the place of.
PENDING, LEASED, DONE, RETIRED = "pending", "leased", "done", "retired"
SCHEMA_VERSION = 4
LEDGER = "item string, config_id string, rel_path string, file_id bigint, mtime timestamp_ntz, scanned_at timestamp_ntz, file_path string, state string, token bigint, lease_until timestamp_ntz, out_path string, superseded boolean, done_at bigint"

_COLUMNS = [c.split()[0] for c in LEDGER.split(", ")]

def newest_versions(files: DataFrame) -> DataFrame:
    """The newest version by scanned_at (ties: the greatest file_id) of each file (config_id, rel_path with / for \\).
    Partial maxima are taken before the shuffle; contents are not read."""
    f = files.select("config_id", F.replace("rel_path", F.lit("\\"), F.lit("/")).alias("rel_path"), F.struct("scanned_at", "file_id", "mtime", "file_path").alias("v"))
    return f.groupBy("config_id", "rel_path").agg(F.max("v").alias("v")).select("config_id", "rel_path", "v.file_id", "v.file_path", "v.mtime", "v.scanned_at")


def item_id(*columns: str) -> Column:
    """The id of a work item: configuration, path and scanned version, so that a file whose mtime goes back is new work."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns or ("config_id", "rel_path", "file_id", "mtime")]), 256)


def state_rows(state: DataFrame, configs: DataFrame, runs: DataFrame, schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """What runs noted about files, of the configuration's own cache and the right version: the rows with run_status."""
    own = configs.select("config_id", "cache_file").filter("config_id is not null and cache_file is not null").distinct()
    noted = runs.select("run_id", "run_status", "started_at").filter("run_id is not null").groupBy("run_id").agg(F.max("run_status").alias("run_status"), F.max("started_at").alias("started_at"))
    s = state.filter(F.col("schema_version") == schema_version).select("config_id", "cache_file", F.replace("rel_path", F.lit("\\"), F.lit("/")).alias("rel_path"), "run_id", "written_at", "state_id", F.col("mtime").alias("noted_mtime"))
    return s.join(own, ["config_id", "cache_file"], "left_semi").join(noted, "run_id")


def build_ledger(files: DataFrame, state: DataFrame, configs: DataFrame, runs: DataFrame, now: datetime | None = None, lease: timedelta = timedelta(hours=6)) -> DataFrame:
    """The ledger (columns of LEDGER) as the runs' notes leave it: one work item for each file's newest version.

    done: the last note of a successful run (greatest written_at, ties: state_id) has the same mtime, to the microsecond;
    an older mtime counts as a change. leased: not done, and a run that is still running noted this very mtime less than
    `lease` after its start; without `now` all such leases have expired. pending: all others, with failed runs' items.
    token is the run that did or holds the item. A null mtime equals only a null one. The item's id and out_path depend
    on configuration, path and version alone, so a repeated run writes to the same place.
    """
    s = state_rows(state, configs, runs)
    last = s.groupBy("config_id", "rel_path").agg(
        F.max(F.when(F.col("run_status") == "success", F.struct("written_at", "state_id", "noted_mtime", "run_id"))).alias("ok"),
        F.max(F.when(F.col("run_status") == "running", F.struct("written_at", "state_id", "noted_mtime", "run_id", "started_at"))).alias("open"),
    )
    new = newest_versions(files)
    j = new.join(last.withColumnsRenamed({"config_id": "_c", "rel_path": "_p"}), new.config_id.eqNullSafe(F.col("_c")) & (new.rel_path == F.col("_p")), "left")
    done = F.col("ok").isNotNull() & F.col("mtime").eqNullSafe(F.col("ok.noted_mtime"))
    until = F.col("open.started_at") + F.lit(lease)
    held = F.col("open").isNotNull() & F.col("mtime").eqNullSafe(F.col("open.noted_mtime")) & ((until > F.lit(now)) if now is not None else F.lit(False))
    held = F.coalesce(held, F.lit(False))
    item = item_id()
    return j.select(
        item.alias("item"), "config_id", "rel_path", "file_id", "mtime", "scanned_at", "file_path",
        F.when(done, DONE).when(held, LEASED).otherwise(PENDING).alias("state"),
        F.when(done, F.col("ok.run_id")).when(held, F.col("open.run_id")).alias("token"),
        F.when(~done & held, until).cast("timestamp_ntz").alias("lease_until"),
        F.concat(F.lit("out/"), F.substring(item, 1, 2), F.lit("/"), item).alias("out_path"), F.lit(False).alias("superseded"), F.when(done, F.lit(0)).cast("bigint").alias("done_at"),
    )


def pending_files(files: DataFrame, state: DataFrame, configs: DataFrame, runs: DataFrame) -> DataFrame:
    """The files that the next run has to take: config_id, rel_path, file_path, file_id, mtime."""
    return build_ledger(files, state, configs, runs).filter(F.col("state") == PENDING).select("config_id", "rel_path", "file_path", "file_id", "mtime")


def run_work(spark: SparkSession, folder: str, files: DataFrame, state: DataFrame, configs: DataFrame, runs: DataFrame, lease: timedelta = timedelta(hours=6)) -> tuple[WorkLedger, int]:
    """Opens a ledger in `folder` with what the runs noted, and leases for a new run all that is to do; the ledger and the
    run's fencing token. The run begins when the leases of all noted runs have expired, so that work which a run that
    never ended still held is pending again."""
    led = WorkLedger(spark, folder)
    led.add(build_ledger(files, state, configs, runs, datetime(1970, 1, 1), lease))
    last = runs.agg(F.max(F.greatest("started_at", "finished_at")).alias("t") if "finished_at" in runs.columns else F.max("started_at").alias("t")).first()["t"]
    return led, led.lease((last or datetime(2000, 1, 1)) + 2 * lease, lease)


class StaleWriter(RuntimeError):
    """A writer whose lease has gone to another one."""


class WorkLedger:
    """A durable ledger in a folder that all executors share, kept as a log of changed items (DeltaLog): each step writes the
    items that it changes, not the ledger. Of two writers that start from the same version one loses and repeats its step.
    Steps are DataFrame plans over the ledger: nothing is collected.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 16):
        self.spark, self.log = spark, DeltaLog(spark, folder, ["item"], every)

    def version(self) -> int:
        return self.log.version()

    def items(self, version: int | None = None) -> DataFrame:
        rows = self.log.read(version)
        return self.spark.createDataFrame([], LEDGER) if rows is None else rows

    def _commit(self, change) -> int:
        try:
            return self.log.commit(lambda old, v: (change(self.spark.createDataFrame([], LEDGER) if old is None else old, v).select(*_COLUMNS), None))
        except Conflict as e:
            raise StaleWriter(str(e)) from e

    def add(self, items: DataFrame) -> int:
        """Adds the items (columns of LEDGER; missing ones are null) that the ledger doesn't have yet; adding again changes
        nothing. Of each file only a version newer (scanned_at, file_id) than all known ones is taken. It is done at once if
        its mtime is that of the file's last finished work; older work of the file that waits is retired, and that
        which is leased is marked, so that it is not leased again."""
        for c in _COLUMNS:
            if c not in items.columns:
                items = items.withColumn(c, F.lit(None).cast(dict(x.split() for x in LEDGER.split(", "))[c]))
        items = items.select(*_COLUMNS).dropDuplicates(["item"])

        def change(old: DataFrame, _: int) -> DataFrame:
            if old.isEmpty():
                return items
            place = F.struct("scanned_at", "file_id")
            known = old.groupBy(F.col("config_id").alias("_c"), F.col("rel_path").alias("_p")).agg(F.max(place).alias("_newest"), F.max(F.when(F.col("state") == DONE, F.struct("done_at", "scanned_at", "file_id", "mtime"))).alias("_done"))
            same = F.col("config_id").eqNullSafe(F.col("_c")) & F.col("rel_path").eqNullSafe(F.col("_p"))
            new = items.join(known, same, "left").filter(F.col("_newest").isNull() | (place > F.col("_newest")))
            settled = (F.col("state") == PENDING) & F.col("_done").isNotNull() & F.col("mtime").eqNullSafe(F.col("_done.mtime"))
            new = new.withColumn("state", F.when(settled, DONE).otherwise(F.col("state"))).withColumn("done_at", F.when(settled, F.col("_done.done_at")).otherwise(F.col("done_at"))).select(*_COLUMNS)
            over = new.select(F.col("config_id").alias("_c"), F.col("rel_path").alias("_p")).distinct()
            waits = old.filter(F.col("state").isin(PENDING, LEASED)).join(over, same, "left_semi")
            waits = waits.withColumn("superseded", F.lit(True)).withColumn("state", F.when(F.col("state") == PENDING, RETIRED).otherwise(F.col("state")))
            return new.unionByName(waits.select(*_COLUMNS))

        return self._commit(change)

    def lease(self, now: datetime, ttl: timedelta, limit: int | None = None) -> int:
        """Leases pending items, and those whose lease has expired, until now + ttl; returns the fencing token, which only
        grows. Expired work with a newer version is retired. With a limit, the first by item id."""

        def change(old: DataFrame, token: int) -> DataFrame:
            free = old.filter((F.col("state") == PENDING) | ((F.col("state") == LEASED) & (F.col("lease_until") <= F.lit(now).cast("timestamp_ntz"))))
            gone = F.coalesce("superseded", F.lit(False))
            if limit is not None:
                free = free.orderBy("item").limit(limit)
            until = F.lit(now + ttl).cast("timestamp_ntz")
            return free.withColumns({"state": F.when(gone, RETIRED).otherwise(LEASED), "token": F.when(gone, F.col("token")).otherwise(F.lit(token).cast("bigint")), "lease_until": F.when(gone, F.col("lease_until")).otherwise(until)})

        token = self._commit(change)
        taken = self.items(token).filter((F.col("state") == LEASED) & (F.col("token") == token)).select("item")
        taken.write.mode("overwrite").parquet(self._taken(token))
        return token

    def _taken(self, token: int) -> str:
        return f"{self.log.folder}/taken/token={token}"

    def leased(self, token: int) -> DataFrame:
        """The items that a token still holds."""
        return self.items().filter((F.col("state") == LEASED) & (F.col("token") == token))

    def _lost(self, items: DataFrame, token: int) -> DataFrame:
        """What the token took and a later one has now."""
        try:
            took = self.spark.read.parquet(self._taken(token))
        except AnalysisException:  # the writer died between the commit and this note: the commit says the same
            took = self.spark.read.parquet(f"{self.log.folder}/v={token}/rows").filter((F.col("state") == LEASED) & (F.col("token") == token)).select("item")
        return took.join(items.filter(F.col("state").isin(LEASED, DONE) & (F.col("token") == token)), "item", "left_anti")

    def complete(self, token: int, done: DataFrame | None = None) -> int:
        """Marks the token's items (or those of `done`, by item) as done. Raises StaleWriter if one of them has gone to a
        later token, and then changes nothing; without `done` that is any item that the token ever took."""

        def change(old: DataFrame, v: int) -> DataFrame:
            mine = old.filter((F.col("state") == LEASED) & (F.col("token") == token))
            d = mine.select("item") if done is None else done.select("item").distinct()
            stale = self._lost(old, token) if done is None else d.join(mine, "item", "left_anti")
            if d.isEmpty() or not stale.isEmpty():
                raise StaleWriter(f"token {token} doesn't hold all of these items")
            return mine.join(d, "item", "left_semi").withColumn("state", F.lit(DONE)).withColumn("done_at", F.lit(v).cast("bigint"))

        return self._commit(change)

    def write(self, token: int, out: DataFrame, folder: str) -> str:
        """Writes the token's output to a path that follows from the token alone; a repeated attempt replaces it. A writer
        that has lost an item to a later token is refused before and after it writes."""
        items = self.items()
        if self.leased(token).isEmpty() or not self._lost(items, token).isEmpty():
            raise StaleWriter(f"token {token} doesn't hold its items")
        path = f"{folder.rstrip('/')}/token={token}"
        out.write.mode("overwrite").parquet(path)
        if not self._lost(self.items(), token).isEmpty():
            self.log._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
            raise StaleWriter(f"token {token} was taken over")
        return path


def read_outputs(spark: SparkSession, ledger: WorkLedger, folder: str) -> DataFrame | None:
    """What tokens with done items wrote, each item once; None before the first."""
    try:
        out = spark.read.parquet(folder)
    except AnalysisException:
        return None
    return out.join(ledger.items().filter(F.col("state") == DONE).select("item", "token"), ["item", "token"], "left_semi")
