"""What the operators of this subpackage share: shared-folder tables, text helpers and a fixed-size membership filter."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, for Java's regular expressions.
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the one all executors share; Hadoop removes it when the driver's JVM ends. Only a session in
    one JVM, as in tests, may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root.rstrip('/')}/rosterflow-{uuid.uuid4().hex}/{name}"
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no more than its own tasks."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def most_files(spark: SparkSession, size: int, each: int) -> int:
    """How many files a table made from ``size`` bytes or rows needs at most, ``each`` to a file: two for every core, or more if it is larger.

    The session's shuffle partitions may be many more than a small table fills, and every file costs a few processes where Hadoop sets
    permissions by commands: until such a child has started its command it shares, and is counted with, all of its executor's memory.
    coalesce() to this number leaves the partitions as they are, one after the other in a task, and moves no row."""
    return max(2 * spark.sparkContext.defaultParallelism, size // each)


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone. Where a text is plain ASCII, lower() gives the same and is cheaper."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


class MembershipFilter:
    """A bitmap of 2**bits hashed keys: fixed size whatever it holds, so it may be broadcast. It has no false negatives."""

    def __init__(self, keys: DataFrame, key: str, bits: int = 25):
        if not 15 <= bits <= 30:
            raise ValueError("bits must be from 15 to 30 (4 KB to 128 MB)")
        self.bits, self.pages = bits, 1 << (bits - 15)
        page, bit = self._place(F.col(key))
        self.bitmap = keys.select(page.alias("_page"), bit.alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))

    @classmethod
    def stored(cls, bitmaps: DataFrame, bits: int) -> MembershipFilter:
        """One filter of the stored bitmaps of several, all of so many bits."""
        out = cls.__new__(cls)
        out.bits, out.pages = bits, 1 << (bits - 15)
        out.bitmap = bitmaps.groupBy("_page").agg(F.bitmap_or_agg("_bits").alias("_bits"))
        return out

    def _place(self, key: Column) -> tuple[Column, Column]:
        h = F.xxhash64(key)
        return F.shiftrightunsigned(h, 15).bitwiseAND(F.lit(self.pages - 1)), h.bitwiseAND(F.lit(32767))

    def mark(self, df: DataFrame, key: str, into: str) -> DataFrame:
        """Adds a boolean: may the key be among those held?"""
        page, bit = self._place(F.col(key))
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.expr("shiftright({}, cast(_bit % 8 as int)) & 1".format("_byte")) == 1, F.lit(False))
        return (
            df.withColumns({"_page": page, "_bit": bit})
            .join(F.broadcast(self.bitmap), "_page", "left")
            .withColumn("_byte", byte)
            .withColumn(into, hit)
            .drop("_page", "_bit", "_bits", "_byte")
        )


class Spread:
    """Joins of many rows with one row per key, where some keys may hold a large part of the rows.

    counts has a row per key with its number of rows, n. Keys of more than twice as many rows as there are shuffle partitions are hot:
    their rows are dealt into that many parts, and their one row goes to each part, which makes at most half as many rows as are joined.
    A bitmap of fixed size marks hot keys; where it errs, a key's one row is copied without need.
    """

    def __init__(self, counts: DataFrame, key: str, n: str = "n"):
        self.parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hot = materialize(counts.filter(F.col(n) > 2 * self.parts).select(key), "hot")
        self.hot = None if hot.isEmpty() else MembershipFilter(hot, key, bits=22)

    def many(self, df: DataFrame, key: str, by: str) -> DataFrame:
        """df with ``_part``; by: a column that tells the rows of a key apart."""
        if self.hot is None:
            return df.withColumn("_part", F.lit(0).cast("long"))
        return self.hot.mark(df, key, "_hot").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(by, F.lit(3)), F.lit(self.parts))).otherwise(0)).drop("_hot")

    def one(self, df: DataFrame, key: str) -> DataFrame:
        if self.hot is None:
            return df.withColumn("_part", F.lit(0).cast("long"))
        last = F.when(F.col("_hot"), self.parts - 1).otherwise(0).cast("long")
        return self.hot.mark(df, key, "_hot").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_hot")

    def join(self, many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
        if self.hot is None:
            return many.join(one, key, how)
        return self.many(many, key, by).join(self.one(one, key), [key, "_part"], how).drop("_part")


def head_of(counts: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, ``most`` at most: a histogram of the counts' logarithms gives the least count that they share."""
    step = F.floor(F.log2(count) * 16)
    kept, least = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if kept + row.n > most:
            break
        kept, least = kept + row.n, row.step
    return counts.filter(step >= F.lit(least)) if least is not None else counts.limit(0)


class WordCache(dict):
    """Values by key, made when first asked for. Two generations of ``size`` bound it: the older one goes when the newer is full."""

    def __init__(self, make, size: int = 150_000, longest: int = 64):
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
