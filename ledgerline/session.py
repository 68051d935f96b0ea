"""Session settings every job relies on.

Money is exact decimal, timestamps are zone-less (the test Parquet is
``timestamp_ntz``) and ``DATE(ts)`` must not depend on the machine's zone, so
each entry point calls :func:`configure` first. The driver owns the session;
we only set the two SQL settings that are safe to change at run time, plus a
checkpoint directory when the session has none (local runs and tests only).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    # AQE re-plans joins from runtime sizes and splits skewed join partitions.
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (``Dataset.checkpoint``).

    On a cluster this must be the shared path named by ``spark.checkpoint.dir``;
    we read it from the session. Only a local-mode session without one (tests,
    the bench) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            f"{_CHECKPOINT_KEY} is not set; posting jobs need a shared checkpoint folder on a cluster"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-ckpt-"))
    return sc.getCheckpointDir()


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the frame as Parquet to a new folder under the
    session's checkpoint folder (shared on a cluster) and read it back.

    One job, columnar and compressed; an eager ``Dataset.checkpoint`` would
    compute the frame twice (once to count, once to write) unless cached."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a frozen frame that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerline") -> SparkSession:
    """Session for tests and the bench: no UI, AQE on, UTC."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
