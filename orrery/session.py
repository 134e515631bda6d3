"""Session helpers: local sessions, the checkpoint folder, table loading."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "orrery", memory: str = "12g") -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster needs a shared one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="orrery-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sort_join(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """a join of two sides that both grow with the data: neither is broadcast, whatever size the optimizer takes it for.

    Keys and hashes compress so well in a shuffle that a side under the threshold there can be many times that in memory."""
    return a.hint("merge").join(b, on, how)


# The plan nodes that keep the partitions of what they read.
_NARROW = {"Project", "Filter", "Generate", "SubqueryAlias", "MapInPandas", "MapInArrow", "Union", "LogicalRDD", "LogicalRelation", "Relation", "DataSourceV2ScanRelation", "LocalRelation", "Range", "InMemoryRelation"}


def _narrow(plan) -> bool:
    name, children = plan.nodeName().split(" ")[0], plan.children().iterator()
    if name not in _NARROW:
        return False
    while children.hasNext():
        if not _narrow(children.next()):
            return False
    return True


def spread(df: DataFrame) -> DataFrame:
    """df, before a Python stage, over at least as many tasks as there are cores.

    Only what comes in fewer splits than cores is moved. What comes in more, or out of a shuffle (whose partitions
    adaptive execution sizes), stays where it is."""
    run = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not _narrow(run.optimizedPlan()) or run.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, wherever they run; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="orrery-"), "orrery.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("orrery", os.path.relpath(full, here)))
    sc.addPyFile(path)
