"""Row-level visibility over a reporting tree."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(users: DataFrame, id_col: str = "id", parent_col: str = "reports_to") -> DataFrame:
    """viewer, member, depth: everyone with all who report to them, however far, and with themselves.

    Paths are doubled in each step until no new pair appears, so the number of steps is the logarithm of the depth. A cycle adds no row
    twice. Each step's pairs are checkpointed, so that plans do not grow with the steps.
    """
    reach = users.select(F.col(id_col).alias("viewer"), F.col(id_col).alias("member"), F.lit(0).alias("depth"))
    step = users.filter(F.col(parent_col).isNotNull()).select(F.col(parent_col).alias("viewer"), F.col(id_col).alias("member"), F.lit(1).alias("depth"))
    context = users.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = users.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    pairs = reach.unionByName(step).groupBy("viewer", "member").agg(F.min("depth").alias("depth")).checkpoint()
    known = pairs.count()
    while True:
        longer = pairs.alias("a").join(pairs.alias("b"), F.col("a.member") == F.col("b.viewer")).select("a.viewer", "b.member", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        pairs = longer.groupBy("viewer", "member").agg(F.min("depth").alias("depth")).checkpoint()
        found = pairs.count()
        if found == known:
            return pairs.join(users.select(F.col(id_col).alias("viewer")), "viewer", "left_semi")
        known = found


def access_counts(users: DataFrame, tree: DataFrame, df: DataFrame, owner_col: str) -> DataFrame:
    """viewer, rows: how many rows each user may see; owners and admins see all."""
    each = df.groupBy(F.col(owner_col).alias("member")).agg(F.count("*").alias("rows"))
    seen = tree.join(each, "member").groupBy("viewer").agg(F.sum("rows").alias("rows"))
    total = df.count()
    role = users.select(F.col("id").alias("viewer"), F.col("role").isin("owner", "admin").alias("_all")).join(seen, "viewer", "left")
    return role.select("viewer", F.when(F.col("_all"), F.lit(total)).otherwise(F.col("rows")).alias("rows")).filter("rows > 0")


def scoped(df: DataFrame, owner_col: str, tree: DataFrame, viewer, role: str) -> DataFrame:
    """Rows whose owner is the viewer or reports to them; owners and admins see all."""
    if role in ("owner", "admin"):
        return df
    seen = tree.filter(F.col("viewer") == viewer).select(F.col("member").alias(owner_col))
    return df.join(seen, owner_col, "left_semi").select(*df.columns)


def visible(df: DataFrame, owner_col: str, visibility_col: str, tree: DataFrame, viewer, role: str) -> DataFrame:
    """Shared rows and those within the viewer's scope."""
    if role in ("owner", "admin"):
        return df
    seen = tree.filter(F.col("viewer") == viewer).select(F.col("member").alias(owner_col), F.lit(True).alias("_seen"))
    return df.join(seen, owner_col, "left").filter((F.col(visibility_col) == "shared") | F.col("_seen")).select(*df.columns)


def team_scoped(df: DataFrame, owner_col: str, members: list) -> DataFrame:
    """One level: a list of ids."""
    return df.filter(F.col(owner_col).isin(members)) if members else df.limit(0)


def may_see(tree: DataFrame, viewer, owner, role: str) -> bool:
    """Access to a single row."""
    return role in ("owner", "admin") or not tree.filter((F.col("viewer") == viewer) & (F.col("member") == owner)).isEmpty()
