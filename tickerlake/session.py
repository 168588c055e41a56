"""Session helpers: the settings every job relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str = "local[8]",
    app_name: str = "tickerlake",
    shuffle_partitions: int = 8,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session for tests, benches and local runs.

    On a cluster the session comes from the launcher; ``prepare_session`` is
    what jobs call on it.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def prepare_session(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators assume.

    Epoch-millisecond columns are turned into naive UTC timestamps and into
    ``dt``/``hr`` partition values, so the session time zone must be UTC.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


_FREE_PARTITIONS = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def keep(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK_DESER) -> DataFrame:
    """``persist`` in as many partitions as the rows ask for, not in all ``spark.sql.shuffle.partitions``.

    By default adaptive execution leaves the last shuffle of a kept table as
    it is. However few rows there are, each of its partitions then writes a
    file for each partition of the next shuffle, and these files, not the
    rows, take the time. The setting is read here and put back.
    """
    conf = df.sparkSession.conf
    before = conf.get(_FREE_PARTITIONS)
    conf.set(_FREE_PARTITIONS, "true")
    try:
        return df.persist(level)
    finally:
        conf.set(_FREE_PARTITIONS, before)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and lineage cuts.

    Uses the folder the cluster names in ``spark.checkpoint.dir``. Only when
    the session has none and runs in one process (local tests) is a local
    temporary folder set; a cluster without one raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickerlake-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def tune_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024) -> int:
    """Size scan splits and shuffle partitions for an input of ``input_bytes``.

    Scan splits and the AQE advisory size are set to ``target_partition_bytes``;
    the initial shuffle partition count is input / target, clamped to
    [200, 50000] (AQE then coalesces small partitions and splits skewed
    ones). At 100 TB the clamp gives 50,000 partitions of about 2 GB of
    scanned input each; after projection and map-side aggregation the
    shuffled bytes are a fraction of that. Returns the count set.
    """
    n = max(200, min(50_000, -(-int(input_bytes) // int(target_partition_bytes))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_partition_bytes))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return n
