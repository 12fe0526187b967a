"""Session defaults shared by the tests, the bench and ad hoc use."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results (time zone) or that every plan here relies on (AQE, Arrow).
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session; on a cluster the caller builds its own and only CORE_CONF matters."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("volatide")
    settings = CORE_CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
