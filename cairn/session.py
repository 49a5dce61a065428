"""Session helpers.

The SparkSession is the only handle (the reference's connection object and its
``DUCKDB_PATH`` switch map onto it): temp views for in-memory work, managed
tables under ``spark.sql.warehouse.dir`` for persistence.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Session settings this library relies on.  AQE re-plans joins from runtime
# sizes (broadcast only when the measured side is small) and splits skewed
# shuffle partitions; UTC keeps date_trunc/date_format engine-independent.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "cairn",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    """Return the active session, or build one with :data:`DEFAULT_CONF`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Make sure the SparkContext has a reliable checkpoint directory.

    Uses ``spark.checkpoint.dir`` when the cluster names one (a shared
    folder).  Only a local-mode session without that setting (tests, local
    benchmarks) gets a fresh scratch folder; elsewhere it must be set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cairn-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
