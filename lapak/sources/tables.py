"""Bucketed tables, reports and listing files (SNK1, SNK2, SNK7, SNK9, T5)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int,
              **options: str) -> DataFrame:
    """Table of a relational database, read in key ranges by many tasks at once."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper),
        numPartitions=str(partitions), **options).load()


def write_listings(listings: DataFrame, path: str, mode: str = "overwrite", format: str = "json") -> None:
    """SNK9: one JSON object per line, nulls written; other formats of Spark by name."""
    listings.write.mode(mode).format(format).option("ignoreNullFields", "false").save(path)


def write_reports(quality: DataFrame, review: DataFrame, path: str, report_date: str) -> list[str]:
    """SNK7: both reports of a day; a second run of the day replaces that day only."""
    paths = []
    for name, report in (("data-quality", quality), ("manual-review", review)):
        target = f"{path}/{name}"
        report.withColumn("report_date", F.lit(report_date)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("report_date").json(target)
        paths.append(target)
    return paths


MARK, BUCKET, PARTS = "bucket", "_bucket", 8


@dataclass(frozen=True)
class BucketedTable:
    """A parquet table in folders by a hash of its key, of which a batch rewrites only those that hold its keys.

    Rows with new keys go to a new folder of their bucket, so that a batch of new rows rewrites nothing. The folders of
    bucket b are the Hive partitions b, b + buckets, b + 2 * buckets and so on; once there are ``PARTS`` of them, the next
    batch for the bucket puts them together. Choose ``buckets`` so that a bucket is some hundred megabytes.
    """

    path: str
    schema: T.StructType
    key: str
    buckets: int = 64

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def exists(self, spark: SparkSession) -> bool:
        place = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    def _stored(self, spark: SparkSession) -> DataFrame:
        layout = T.StructType([*self.schema.fields, T.StructField(MARK, T.IntegerType())])
        return spark.read.schema(layout).option("basePath", self.path).parquet(self.path).filter(F.col(self.key).isNotNull())

    def read(self, spark: SparkSession, folders: list[int] | None = None) -> DataFrame:
        """All rows, or those of some folders."""
        if folders == [] or not self.exists(spark):
            return spark.createDataFrame([], self.schema).limit(0)
        rows = self._stored(spark)
        return (rows if folders is None else rows.filter(F.col(MARK).isin(*folders))).drop(MARK)

    def folders(self, spark: SparkSession, *keys: DataFrame) -> tuple[list[int], list[int]]:
        """(folders that hold one of the keys in one-column tables, for each bucket the folder to write).

        Only buckets of the keys are read. At most ``PARTS`` numbers a bucket reach the driver.
        """
        asked = reduce(DataFrame.unionByName, [k.toDF(self.key) for k in keys])
        buckets = {r[0] for r in asked.select(self.bucket(F.col(self.key))).distinct().collect()}
        live: dict[int, list] = {}
        if buckets and self.exists(spark):
            stored = self._stored(spark).filter(F.pmod(F.col(MARK), F.lit(self.buckets)).isin(*buckets)).select(self.key, MARK)
            found = stored.join(asked.distinct().withColumn("_hit", F.lit(True)), self.key, "left")
            for folder, hit in found.groupBy(MARK).agg(F.max("_hit")).collect():
                live.setdefault(folder % self.buckets, []).append((folder, hit))
        held, to = [], list(range(self.buckets))
        for b, own in live.items():
            mine = sorted(folder for folder, hit in own if hit or len(own) >= PARTS)
            free = set(range(b, b + self.buckets * (PARTS + 1), self.buckets)) - {folder for folder, _ in own}
            held += mine
            to[b] = mine[0] if mine else min(free)
        return sorted(held), to

    def spread(self, rows: DataFrame, held: list[int]) -> tuple[DataFrame, tuple[str, ...]]:
        """(rows of a batch, columns that they have been shuffled by).

        A batch that rewrites no folder is shuffled once, by bucket, from here to its files; others meet stored rows first.
        """
        if held:
            return rows, ()
        return rows.withColumn(BUCKET, self.bucket(F.col(self.key))).repartition(BUCKET), (BUCKET,)

    def stage(self, rows: DataFrame, held: list[int], to: list[int], path: str, near: tuple[str, ...] = ()) -> None:
        """Write beside the table the rows of the folders ``held`` and new ones, each to the folder of its bucket.

        Each held folder gets a row without key, so that one that has lost all its rows is replaced too. A folder is
        written by one task; that takes one more shuffle unless the rows come from ``spread`` with columns ``near``.
        """
        spark, place = rows.sparkSession, F.element_at(F.lit(to), self.bucket(F.col(self.key)) + 1)
        filled = rows.select(*self.schema.fieldNames(), place.alias(MARK))
        if held:
            none = spark.createDataFrame([(b,) for b in held], "bucket int").select(
                *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], MARK)
            filled = filled.unionByName(none)
        if not near:
            filled = filled.repartition(MARK)
        filled.write.mode("overwrite").option("compression", "zstd").partitionBy(MARK).parquet(path)

    def replace(self, spark: SparkSession, staged: str) -> None:
        """Move staged folders to the place of the old ones. Doing it again moves those that are still staged."""
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        files = fs_path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(fs_path(self.path))
        for folder in files.listStatus(fs_path(staged)):
            place = fs_path(self.path, folder.getPath().getName())
            if folder.isDirectory() and place.getName().startswith(f"{MARK}="):
                files.delete(place, True)
                if not files.rename(folder.getPath(), place):
                    raise OSError(f"cannot move {folder.getPath()} to {place}")


def apply_once(spark: SparkSession, folder: str, name: str, prepare: Callable[[str], None], apply: Callable[[str], None]) -> None:
    """Prepare files below ``folder/name``, then apply them; repeated under the same name the same files are applied.

    A job that is lost between the two, or half way through the second, is repeated from the files as they were
    prepared, never from a table that has been changed in part. Files of earlier names go when the next ones are in
    place.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    place, parent = fs_path(f"{folder}/{name}"), fs_path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    ready = fs_path(f"{folder}/{name}/_READY")
    if not files.exists(ready):
        files.delete(place, True)
        prepare(f"{folder}/{name}")
        files.create(ready, True).close()
    apply(f"{folder}/{name}")
    for old in files.listStatus(parent):
        if old.getPath().getName() != name:
            files.delete(old.getPath(), True)
