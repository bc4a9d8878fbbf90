"""Spark session with the settings the jobs rely on."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

# How much data a task should get.
TASK_BYTES = 128 * 1024 * 1024
# Each scan task keeps a record of each shuffle partition, so for very large inputs
# tasks grow instead of becoming more.
MAX_SCAN_TASKS = 100_000
MAX_SHUFFLE_PARTITIONS = 20_000


def get_spark(
    app_name: str,
    master: str | None = None,
    input_bytes: int | None = None,
    conf: dict[str, str] | None = None,
    max_scan_tasks: int = MAX_SCAN_TASKS,
    max_shuffle_partitions: int = MAX_SHUFFLE_PARTITIONS,
) -> SparkSession:
    """Session for the jobs.

    ``input_bytes`` is the size of the source tables. It sets how large a piece of
    a file each task reads, and how many shuffle partitions adaptive execution
    starts from; it then merges those that turn out small. Without it Spark's own
    defaults apply. ``max_scan_tasks`` and ``max_shuffle_partitions`` bound the two; tasks
    of larger inputs grow.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = settings_for(input_bytes, max_scan_tasks, max_shuffle_partitions)
    for name, value in (settings | (conf or {})).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def settings_for(
    input_bytes: int | None,
    max_scan_tasks: int = MAX_SCAN_TASKS,
    max_shuffle_partitions: int = MAX_SHUFFLE_PARTITIONS,
) -> dict[str, str]:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot join key even where that costs one more shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        # Hash joins instead of sorting, where every part of one side is this small.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(TASK_BYTES),
        # A task writing a few partitions keeps a file open for each; no sort.
        "spark.sql.maxConcurrentOutputFileWriters": "16",
        # Recording a stack trace per column takes as long as planning a query.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if input_bytes is not None:
        partitions = max(200, math.ceil(input_bytes / TASK_BYTES))
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(
            min(partitions, max_shuffle_partitions)
        )
        settings["spark.sql.files.maxPartitionBytes"] = str(
            max(TASK_BYTES, math.ceil(input_bytes / max_scan_tasks))
        )
    return settings
