"""Where a run writes, and which run readers see.

Each run writes below a path of its own. Once its checks have passed, one row is
appended to a log, and readers follow the newest row. No table is copied or
overwritten to publish it, and a failed run leaves the last good one in place.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.contracts import gold_schema
from ledgermill.sources.layers import read_layer

LOG_DDL = "run_id string, run_ts timestamp, sequence bigint"


class NothingPublished(Exception):
    """No run below this directory has passed its checks yet."""


@dataclass(frozen=True)
class Run:
    dst_dir: str
    run_id: str
    run_ts: datetime

    def path(self, layer: str, table: str) -> str:
        return f"{self.dst_dir}/runs/{self.run_id}/{layer}/{table}"


def start_run(spark: SparkSession, dst_dir: str, run_ts: datetime) -> Run:
    """Names the run after its timestamp.

    A retry of a run that was not published gets the same name and replaces what
    the failed attempt left. Once published, its name is not used again, so the
    tables readers see are never overwritten. Runs of one directory must not
    overlap.
    """
    stamp = f"{run_ts:%Y%m%dT%H%M%S}"
    earlier = published_runs(spark, dst_dir).filter(F.col("run_id").startswith(stamp)).count()
    return Run(dst_dir, f"{stamp}-{earlier}", run_ts)


def publish(spark: SparkSession, run: Run) -> None:
    sequence = published_runs(spark, run.dst_dir).count()
    row = spark.range(1).select(
        F.lit(run.run_id).alias("run_id"),
        F.lit(run.run_ts).cast("timestamp").alias("run_ts"),
        F.lit(sequence).cast("bigint").alias("sequence"),
    )
    row.write.mode("append").parquet(_log_path(run.dst_dir))


def published_runs(spark: SparkSession, dst_dir: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_DDL).parquet(_log_path(dst_dir))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_DDL)


def current_run(spark: SparkSession, dst_dir: str) -> Run:
    newest = published_runs(spark, dst_dir).orderBy(F.desc("sequence")).first()
    if newest is None:
        raise NothingPublished(dst_dir)
    return Run(dst_dir, newest.run_id, newest.run_ts)


def read_gold(spark: SparkSession, dst_dir: str, table: str) -> DataFrame:
    """A gold table of the newest published run."""
    path = current_run(spark, dst_dir).path("gold", table)
    return read_layer(spark, path, gold_schema(table))


def _log_path(dst_dir: str) -> str:
    return f"{dst_dir}/published"
