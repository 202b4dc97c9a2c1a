"""Session helpers: a local session for tests and benches, and the shared
checkpoint folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "concilia") -> SparkSession:
    """Local session with AQE on and the web UI off (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CONCILIA_DRIVER_MEM", "8g"))
    )
    spark = builder.getOrCreate()
    spark.conf.set(INPUT_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared, durable folder and
    is used as is. Only when it is unset in local mode (tests) a scratch
    folder is created and registered; elsewhere the executors would not see
    such a folder, so a missing setting raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="concilia-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the
    loss of the executors that computed it)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def package_on_workers(spark: SparkSession) -> None:
    """This package on the Python workers' path (the same path as here;
    elsewhere it is shipped with --py-files)."""
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def on_workers(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the Python workers' path."""
    package_on_workers(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Partitions into which the supplied tables are dealt where a session asks for it (tests and benches on tables of one
#: row group); clusters leave it unset and read the splits of their files.
INPUT_PARTITIONS = "spark.concilia.inputPartitions"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many partitions as the session asks for, whatever its size; as it is where it asks for none."""
    want = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(want)) if want else df
