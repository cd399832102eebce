"""Session helpers: building a local session for tests and resolving the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


# Settings we run with on a large cluster (100 TB of documents, ~1000 executors). Documents are wide rows (KB to MB of
# text), so splits and shuffle partitions are sized in bytes, not rows; AQE coalesces small shuffle partitions,
# splits skewed ones, and turns a join into a broadcast only when a side is measured below the threshold at run time.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.session.timeZone": "UTC",
}


def apply_cluster_conf(spark: SparkSession, overrides: dict | None = None) -> None:
    """Set the runtime SQL settings above (those the session lets change at run time)."""
    for k, v in {**CLUSTER_CONF, **(overrides or {})}.items():
        spark.conf.set(k, v)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quire") -> SparkSession:
    """A local session with the settings the tests and the bench use. UI off, UTC, AQE on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(SPREAD, str(spark.sparkContext.defaultParallelism))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the setting names a shared folder and is used as is. Only where it is unset and the session is local
    (tests) a scratch folder is created and set; on a cluster without the setting this raises, since a folder of one
    machine would be lost to the others.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        try:
            current = spark.sparkContext.getCheckpointDir()
        except Exception:  # noqa: BLE001  (no SparkContext behind a remote session)
            current = None
    if current:
        return current
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="quire-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # noqa: BLE001
        pass
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written intermediate tables and sinks."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


#: Session setting: partitions that ``table`` deals small tables out to by their key. ``local_session`` sets it, since the
#: test tables are one row group each and would run in one task; unset, as on a cluster, tables keep their splits, whose
#: size is ``spark.sql.files.maxPartitionBytes``.
SPREAD = "spark.quire.spread"


def spread(df: DataFrame, partitions: int, key: str | tuple[str, ...] = "doc_id") -> DataFrame:
    """Hash-repartition by ``key``: an explicit choice of the caller, for inputs with too few splits. A later per-document
    regroup or window reuses this partitioning."""
    return df.repartition(partitions, *((key,) if isinstance(key, str) else key))


# Document-like tables and their keys. Each key is unique per row, so
# the spread is even; a conversation is spread by (conv_id, turn), since one conversation may hold many turns.
DOC_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": ("conv_id", "turn"), "benchmark": "item_id",
            "events": "event_id", "labels": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one test table, spread by its key where the session sets ``SPREAD``. Column pruning and filters reach the
    Parquet scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key, partitions = DOC_KEYS.get(name), spark.conf.get(SPREAD, None)
    return spread(df, int(partitions), key) if key and partitions else df
