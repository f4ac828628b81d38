"""Session defaults shared by the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "keelson", cores: str | int = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def work_dir(spark: SparkSession, default: str = "/tmp/keelson-work") -> str:
    """Folder that all executors share: spark.checkpoint.dir of the session. Only a local master does without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or default


def use_checkpoints(spark: SparkSession) -> str:
    """Point checkpoint() at the shared folder and return it. An earlier setting stays."""
    d = work_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d
