"""SparkSession settings for this engine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster pass nothing and let spark-submit decide the rest."""
    builder = SparkSession.builder.appName("tessera")
    if master:
        cores = os.cpu_count() if "*" in master else int("".join(filter(str.isdigit, master)) or 1)
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
