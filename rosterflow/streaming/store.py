"""A table of rows by key for streams: a micro-batch reads only the buckets that its keys fall into, and few files of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BucketStore:
    """The latest row of each key, in ``buckets`` buckets of the key's hash under ``path``.

    A batch adds a run to each bucket that it touches. Where a bucket has ``runs`` runs, the new one takes all of its rows in, and the
    older ones are no longer read. So a batch reads at most ``runs`` files for each bucket touched, however long the store has grown; the
    rows of a bucket grow with the keys, which a larger number of buckets keeps small. Runs carry their batch's number, and a batch looks
    only at those before its own: a repeated batch sees what it saw the first time and writes the same runs again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 256, runs: int = 8):
        self.spark, self.path, self.keys, self.buckets, self.limit = spark, path.rstrip("/"), keys, buckets, runs
        self.schema = T.StructType([*schema.fields])
        self.columns = self.schema.names

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def runs_of(self, bucket: int, before: int) -> list[str]:
        """Paths of a bucket's runs of earlier batches, newest first, up to the last that holds all rows."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = sorted((x.getPath().getName() for x in files.listStatus(folder) if x.isDirectory()), reverse=True)
        out = []
        for name in names:  # run=000000000012-part or -whole
            number, kind = name.removeprefix("run=").split("-")
            if int(number) < before:
                out.append(f"{self.path}/bucket={bucket}/{name}")
                if kind == "whole":
                    break
        return out

    def touched(self, df: DataFrame) -> list[int]:
        """The buckets of df's keys, of which there are ``buckets`` at most."""
        return sorted(r.bucket for r in self.placed(df).select("bucket").distinct().collect())

    def rows(self, buckets: list[int], before: int) -> tuple[DataFrame, dict[int, int]]:
        """The latest rows of all keys in these buckets, and how many runs each bucket has."""
        paths = {b: self.runs_of(b, before) for b in buckets}
        schema = T.StructType([*self.schema.fields]).add("bucket", "integer").add("run", "string")
        if not any(paths.values()):
            return self.spark.createDataFrame([], schema).drop("run"), {}
        held = self.spark.read.schema(schema).option("basePath", self.path).parquet(*[p for ps in paths.values() for p in ps])
        latest = held.groupBy(*self.keys, "bucket").agg(F.max_by(F.struct(*self.columns), "run").alias("_row"))
        return latest.select("_row.*", "bucket"), {b: len(ps) for b, ps in paths.items()}

    def lookup(self, df: DataFrame, batch: int) -> DataFrame:
        """The store's rows of df's keys, as they were before the batch."""
        held, _ = self.rows(self.touched(df), batch)
        wanted = df.select(*self.keys).distinct()
        return held.join(wanted, [held[k].eqNullSafe(wanted[k]) for k in self.keys], "left_semi").select(*self.columns)

    def put(self, df: DataFrame, batch: int) -> None:
        """Rows, one for each key, take the place of those that the store has."""
        buckets = self.touched(df)
        held, counts = self.rows(buckets, batch)
        new = self.placed(df.select(*self.columns))
        full = [b for b in buckets if counts.get(b, 0) >= self.limit]
        kept = held.filter(F.col("bucket").isin(full)) if full else held.limit(0)
        kept = kept.join(new, [kept[k].eqNullSafe(new[k]) for k in self.keys], "left_anti")
        kind = F.when(F.col("bucket").isin(full), "whole").otherwise("part") if full else F.lit("part")
        out = new.unionByName(kept.select(new.columns)).withColumn("run", F.concat(F.lit(f"{batch:012d}-"), kind))
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run").parquet(self.path)
