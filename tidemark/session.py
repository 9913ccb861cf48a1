"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Days and hours are computed on UTC time stamps; skewed joins and small partitions are left to AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # timers and state by key for streams
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted session is used instead."""
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | more
    return SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
