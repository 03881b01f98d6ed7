"""Exact dedup over a log-structured index of text digests, in DataFrame operations alone.

Flushing a batch writes a run of (digest, id): each file is one memtable of at most ``memtable_rows`` rows, sorted by digest, and beside
the run stands its filter, a bitmap of fixed size. Compaction merges the runs that are not yet in the level with the level, which has a
row per digest, in order: its smallest and largest id and its count. A lookup probes the filters of all runs first; only what they let
through is joined to the level. Digests that more than one row has are hits; only the texts of rows that may be hits are read again,
grouped by digest *and* text, so that equality is by bytes and a digest collision splits into its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MembershipFilter, Spread, ascii_lower, materialize, most_files, scratch_path


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs of digests under ``path``. Batches may be flushed at any time; compact() merges what has been flushed since it last ran."""

    def __init__(self, spark: SparkSession, path: str | None = None, memtable_rows: int = 200_000, digest=sha256, filter_bits: int = 25):
        self.spark, self.path = spark, path or scratch_path(spark, "index")
        self.memtable_rows, self.digest, self.filter_bits = memtable_rows, digest, filter_bits
        self.flushed = self.merged = self.levels = 0

    def rows(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        text = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
        return text.withColumn("digest", self.digest(F.col("text")))

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        run = f"{self.path}/runs/run={self.flushed}"
        self.rows(docs, id_col, text_col).select("digest", "id").sortWithinPartitions("digest", "id").write.option("maxRecordsPerFile", self.memtable_rows).parquet(run)
        bitmap = MembershipFilter(self.spark.read.parquet(run), "digest", self.filter_bits).bitmap
        bitmap.coalesce(most_files(self.spark, 1 << (self.filter_bits - 3), 8 << 20)).write.parquet(f"{self.path}/filters/run={self.flushed}")
        self.flushed += 1

    def runs(self, start: int = 0) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/runs/run={k}" for k in range(start, self.flushed)])

    def level(self) -> DataFrame:
        """One row per digest: digest, least_id, last_id, n."""
        return self.spark.read.parquet(f"{self.path}/levels/level={self.levels - 1}")

    def compact(self) -> DataFrame:
        """The level after the runs flushed since the last compaction have been merged into it."""
        if self.merged < self.flushed:
            new = self.runs(self.merged).select("digest", F.col("id").alias("least_id"), F.col("id").alias("last_id"), F.lit(1).cast("long").alias("n"))
            rows = new.unionByName(self.level()) if self.levels else new
            level = rows.groupBy("digest").agg(F.min("least_id").alias("least_id"), F.max("last_id").alias("last_id"), F.sum("n").alias("n"))
            level = level.coalesce(most_files(self.spark, rows.count(), self.memtable_rows))
            level.sortWithinPartitions("digest").write.parquet(f"{self.path}/levels/level={self.levels}")
            self.merged, self.levels = self.flushed, self.levels + 1
        return self.level()

    def filter(self) -> MembershipFilter:
        """Of all flushed digests: the bitmaps of the runs, put together."""
        return MembershipFilter.stored(self.spark.read.parquet(*[f"{self.path}/filters/run={k}" for k in range(self.flushed)]), self.filter_bits)

    def contains(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs' ids with ``known``: is the digest in the compacted level? A later batch asks this before it is flushed. Rows that the
        filter does not let through are new, and meet nothing."""
        asked = self.filter().mark(self.rows(docs, id_col, text_col).select("id", "digest"), "digest", "maybe")
        level = self.level().select("digest", F.lit(True).alias("known"))
        met = asked.filter("maybe").join(level, "digest", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))
        return asked.filter("not maybe").select("id", F.lit(False).alias("known")).unionByName(met).withColumnRenamed("id", id_col)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", filter_bits: int = 25, index: DigestIndex | None = None):
    """The index after flushing and compacting docs, the filter of its hits, how to spread the hits that very many rows have, and the
    hits' verified classes.

    Classes have digest, text, keep_id and group_size, 1 for a text that only shares its digest, or its place in the filter;
    texts compare equal after lower-casing A-Z; a null text is the empty text.
    """
    index = index or DigestIndex(docs.sparkSession)
    index.flush(docs, id_col, text_col)
    hits = index.compact().filter("n > 1")
    spread = Spread(hits, "digest")
    sieve = MembershipFilter(hits, "digest", filter_bits)
    kept = F.max("id") if keep == "largest" else F.min("id")
    classes = sieve.mark(index.rows(docs, id_col, text_col), "digest", "_hit").filter("_hit").groupBy("digest", "text").agg(kept.alias("keep_id"), F.count("*").alias("group_size"))
    classes = classes.coalesce(most_files(docs.sparkSession, index.runs().count(), 1_000))
    return index, sieve, spread, classes


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", filter_bits: int = 25, digest=sha256) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, digest.

    Of equal texts the row with the largest (or smallest) id stays. Repeated rows with one id and text are all reported, each as kept if
    its id is the one that stays. An empty table gives an empty result; columns of docs other than the two named are not looked at.
    Texts count whole, whatever their length; a null id is least of all, and stays only where its whole group has none.
    """
    index, _, spread, classes = exact_groups(docs, id_col, text_col, keep, filter_bits, DigestIndex(docs.sparkSession, digest=digest))
    # single texts are counted, as a digest may have one beside a group of copies; they themselves are not stored
    classes = materialize(classes.withColumn("text", F.expr("if(group_size > 1, text, null)")), "classes")
    several = classes.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    classes = classes.filter("group_size > 1")
    rows = index.runs()
    if several.isEmpty():
        found = spread.join(rows, classes.drop("text"), "digest", by="id", how="left")
    else:  # a digest with more than one text: these rows are told apart by their texts
        texts = index.rows(docs, id_col, text_col).join(several, "digest", "left_semi").join(classes, ["digest", "text"], "left").drop("text")
        found = spread.join(rows.join(several, "digest", "left_anti"), classes.drop("text"), "digest", by="id", how="left").unionByName(texts)
    keep_id = F.coalesce("keep_id", "id")
    return found.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (keep_id.eqNullSafe(F.col("id"))).alias("kept"), "digest",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", filter_bits: int = 25) -> DataFrame:
    """docs without copies, all columns kept. Rows whose digest no other row has pass straight from the scan; only possible copies are
    shuffled. Rows that repeat one id and text leave one row."""
    index, sieve, spread, classes = exact_groups(docs, id_col, text_col, keep, filter_bits)
    classes = materialize(classes.filter("group_size > 1"), "classes")
    row = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    row = sieve.mark(row.withColumn("_digest", index.digest(F.col("_text"))), "_digest", "_hit")
    alone = row.filter("not _hit").select("_row.*")
    each = classes.select(F.col("digest").alias("_digest"), F.col("text").alias("_text"), "keep_id", "group_size")
    maybe = spread.many(row.filter("_hit"), "_digest", by="_id").join(spread.one(each, "_digest"), ["_digest", "_part", "_text"], "left")
    unmatched = maybe.filter("group_size is null").select("_row.*")
    leaders = maybe.filter("group_size is not null").filter(F.col("keep_id").eqNullSafe(F.col("_id"))).dropDuplicates(["_digest", "_id"]).select("_row.*")
    return alone.unionByName(unmatched.unionByName(leaders).coalesce(most_files(docs.sparkSession, index.runs().count(), 1_000)))
