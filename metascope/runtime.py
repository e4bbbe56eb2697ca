"""Session helpers: table access, lineage cuts in the shared folder, bounded broadcasts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters taken as blanks at the ends of identifiers.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85                 　﻿"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Only where it is unset
    (a local session, as in tests) a folder of our own is made and set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    known = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not known:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="metascope-checkpoint-")
    sc.setCheckpointDir(known)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, which goes when the driver's JVM ends."""
    made = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """`df` computed once, written as a table into the shared folder and read back, so that a lost executor costs no
    recomputation and the optimizer knows its size."""
    made = scratch(df.sparkSession, "cut")
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(made)
    return df.sparkSession.read.schema(df.schema).parquet(made)


def clean_key(col):
    """An identifier without outer blanks and letter case; null where nothing is left."""
    return F.nullif(F.lower(F.btrim(col, F.lit(BLANKS))), F.lit(""))


def ship(spark: SparkSession) -> bool:
    """Sends this package to the Python workers where they would not find it by themselves: on a real cluster, or in local
    mode if neither PYTHONPATH nor the working folder holds it. Once for each context; whether it was sent."""
    sc = spark.sparkContext
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    places = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if getattr(sc, "_metascope_sent", False) or (sc.master.startswith("local") and here in places):
        return False
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(os.path.dirname(os.path.abspath(__file__))):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, here))
    with tempfile.NamedTemporaryFile(prefix="metascope-", suffix=".zip", delete=False) as f:  # the driver serves it to all workers
        f.write(data.getvalue())
    sc.addPyFile(f.name)
    sc._metascope_sent = True
    return True
