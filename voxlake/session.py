"""Session helpers: settings, checkpoint folder, partition counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session with the settings the operators expect; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("voxlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    measure_broadcasts(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def measure_broadcasts(spark: SparkSession, limit: str = "64m") -> None:
    """Broadcast only on sizes measured at run time.

    The planner's own estimate misses rows made by explode (grids, tiles, offsets), so it could broadcast a
    huge side; adaptive execution decides from the bytes a stage really wrote.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)


def num_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of its input that a task takes, and the fewest that are worth a task of their own.
TASK_ROWS, LEAST_ROWS = 200_000, 25_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for work on a table of ``rows``: a task's share doesn't grow with the table, and few rows make few tasks.

    Adaptive execution makes partitions as large as its advisory size; where rows multiply behind a shuffle, that is too much.
    """
    return max(-(-rows // TASK_ROWS), min(num_partitions(spark), -(-rows // LEAST_ROWS)), 1)


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` over ``parts``, or over as many as adaptive execution chooses."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one is made only in local mode."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if shared:
        return shared
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="voxlake-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Bytes in memory up to which a cut table's size is told to the planner: what a driver can send to every task.
TOLD_BYTES = 4 << 20


def _weight(df: DataFrame) -> Column:
    """About the bytes of a row in memory: eight for each column, and what its texts and arrays hold."""
    parts = [F.lit(8 * len(df.columns)).cast("bigint")]
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.octet_length(column))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            parts.append(F.greatest(F.size(column), F.lit(0)) * 8)
    return sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), parts[0])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared checkpoint folder and read them back.

    The table outlives lost executors, and later steps do not repeat the work. Only a table that is small in memory has a size
    for the planner, which then may broadcast it. Equal values pack so well that the files of a big one may be a hundredth of its
    rows; it is read beside an empty RDD, whose size is not known, so that the bytes a join's shuffles wrote decide.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.coalesce(F.sum(_weight(df)), F.lit(0)).alias("bytes")).write.parquet(path)
    _CUTS.append(path)
    rows = spark.read.schema(df.schema).parquet(path)
    if seen.get["bytes"] <= TOLD_BYTES:
        return rows
    return rows.union(spark.createDataFrame(spark.sparkContext.emptyRDD(), rows.schema))


#: Tables that ``cut_lineage`` has written in this driver and that are still there.
_CUTS: list[str] = []


def remove_cuts(spark: SparkSession) -> int:
    """Remove the tables that ``cut_lineage`` wrote, once no DataFrame that reads them is needed; returns how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = len(_CUTS)
    while _CUTS:
        at = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        at.getFileSystem(conf).delete(at, True)
    return done
