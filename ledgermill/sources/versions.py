"""Tables kept by year, each year read from the run that wrote it last.

A run writes the years it changes below a path of its own and then appends one commit: which
source files it has taken in, and which years of which tables it has written. Nothing is
overwritten, so a run that fails leaves all as it was, and one that is repeated starts
from the same state. Runs of one directory must not overlap.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

YEAR = "order_year"
# Of a file: path, size and time, and the years its rows are in. Of a year: its number, and
# the run that wrote it. A null run says that the file or the rows of the year are gone.
COMMIT_DDL = (
    "sequence bigint, kind string, table_name string, name string, size bigint, "
    "modified timestamp, years array<int>, run_id string"
)


class YearlyTables:
    """The tables of one directory, as the newest commit leaves them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMIT_DDL).parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT_DDL)

    def next_sequence(self) -> int:
        newest = self.commits().agg(F.max("sequence")).first()[0]
        return 0 if newest is None else newest + 1

    def _newest(self, kind: str, table: str) -> DataFrame:
        of_table = (F.col("kind") == kind) & (F.col("table_name") == table)
        newest = self.commits().filter(of_table).groupBy("name").agg(
            F.max_by(F.struct("size", "modified", "years", "run_id"), "sequence").alias("last")
        )
        return newest.select("name", "last.*").filter("run_id is not null")

    def files(self, table: str) -> DataFrame:
        """Source files that have been taken in: file, size, modified, years."""
        return self._newest("file", table).select(
            F.col("name").alias("file"), "size", "modified", "years"
        )

    def versions(self, table: str) -> dict[int, str]:
        """The run that holds each year; a table has few years."""
        return {int(row.name): row.run_id for row in self._newest("year", table).collect()}

    def run_path(self, run_id: str, table: str) -> str:
        return f"{self.path}/runs/{run_id}/{table}"

    def read(
        self, table: str, schema: StructType, years: Collection[int] | None = None
    ) -> DataFrame:
        """The rows of the table, or of some of its years, from the folders of these years only."""
        folders: dict[str, list[int]] = {}
        for year, run_id in self.versions(table).items():
            if years is None or year in years:
                folders.setdefault(run_id, []).append(year)
        frames = [self.read_run(run_id, table, schema, of) for run_id, of in folders.items()]
        if not frames:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, frames)

    def read_run(
        self, run_id: str, table: str, schema: StructType, years: Iterable[int]
    ) -> DataFrame:
        path = self.run_path(run_id, table)
        folders = [f"{path}/{YEAR}={year}" for year in sorted(years)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", path).parquet(*folders)
        return rows.select(*schema.names)

    def commit(
        self,
        sequence: int,
        run_id: str,
        files: DataFrame,
        written: dict[str, tuple[Collection[int], Collection[int]]],
    ) -> None:
        """Appends the files taken in (table_name, file, size, modified, years, kept), and per
        table the years that were replaced and those of them that still have rows."""
        years = [
            ("year", table, str(year), run_id if year in left else None)
            for table, (replaced, left) in written.items()
            for year in sorted(replaced)
        ]
        of_years = self.spark.createDataFrame(
            years, "kind string, table_name string, name string, run_id string"
        )
        of_files = files.select(
            F.lit("file").alias("kind"),
            "table_name",
            F.col("file").alias("name"),
            "size",
            "modified",
            "years",
            F.when(F.col("kept"), run_id).alias("run_id"),
        )
        rows = of_files.unionByName(of_years, allowMissingColumns=True)
        columns = StructType.fromDDL(COMMIT_DDL).names
        # One file, so that readers see all of a commit or nothing.
        rows = rows.withColumn("sequence", F.lit(sequence).cast("bigint")).select(*columns)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
