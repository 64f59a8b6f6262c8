"""Session settings the library counts on, and the shared folder for state."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 16 << 20
_local_dirs: dict[str, str] = {}


def build_session(app_name: str = "emblema", master: str | None = None, **settings) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local master, where driver and tasks share one machine, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="emblema-")
    return _local_dirs[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A table just read, its rows over all cores if the files give fewer splits than there are cores, as a single
    small file does. A table of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, cut from its lineage, and safe when
    executors are lost. For results that are small beside what they are computed from."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, text: str) -> DataFrame | None:
    """``df`` marked for broadcast if a count shows few rows and little text, else None."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(text)).alias("chars")).first()
    small = size["rows"] <= BROADCAST_ROWS and (size["chars"] or 0) <= BROADCAST_CHARS
    return F.broadcast(df) if small else None
