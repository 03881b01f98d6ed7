"""A manifest of a dataset as a tree of digests: a subtree for each partition key, and a root over the subtrees.

Leaves are numbered within their subtree by a range partitioning, and cut into aligned blocks of a power of two. One task walks a block in
postorder: the walk returns a subtree's digest, and while it unwinds appends to each leaf below the sibling that it met there. The digests
of blocks are the leaves of the next, ``block`` times smaller walk, up to one block for each subtree; the subtrees' digests make a tree in
the same way. A leaf's siblings, its proof, are those from its own block, then those of its block, and so on. No task holds more than a
block's leaves, and only small rows are shuffled: texts stay where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read alike; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def join(left: bytes, right: bytes = b"") -> bytes:
    """A parent's digest. Digests go in as lowercase hexadecimal text."""
    return hashlib.sha256(left.hex().encode() + right.hex().encode()).digest()


def climb(nodes: list[bytes], height: int) -> tuple[bytes, list[bytes]]:
    """The digest ``height`` levels above nodes, and each node's siblings on the way there, lowest first, as joined bytes. A last node
    without a sibling becomes its own parent's only child."""
    siblings = [bytearray() for _ in nodes]

    def walk(start: int, stop: int, level: int) -> bytes:
        if not level:
            return nodes[start]
        middle = start + (1 << level - 1)
        left = walk(start, min(middle, stop), level - 1)
        if middle >= stop:
            return join(left)
        right = walk(middle, stop, level - 1)
        for k in range(start, middle):
            siblings[k] += right
        for k in range(middle, stop):
            siblings[k] += left
        return join(left, right)

    return walk(0, len(nodes), height), [bytes(s) for s in siblings]


def fold(leaf: bytes, proof: bytes, *places: tuple[int, int]) -> bytes:
    """The root that a leaf and its proof lead to. places: (place, number of nodes) in each tree passed, from the leaf's own upwards."""
    node, used = leaf, 0
    for place, n in places:
        while n > 1:
            sibling = b""
            if place ^ 1 < n:
                sibling, used = proof[used : used + 32], used + 32
            node = join(sibling, node) if place & 1 else join(node, sibling)
            place, n = place >> 1, n + 1 >> 1
    return node


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """rows with ``place`` (from 0, in order within their tree) and ``n`` (the tree's rows). The rows are written in order once; a
    row's number within its file and the files' sizes give its place, so that no tree is gathered, however large."""
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = dealt.repartitionByRange(tree, *order, "_tie").sortWithinPartitions(tree, *order, "_tie").drop("_tie")
    at = F.monotonically_increasing_id()
    written = materialize(ordered.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), name)
    runs = written.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))  # as many as files and trees
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(tree, "_part", (before - F.col("_first")).alias("_add"), F.sum("_size").over(whole).alias("n"))
    return written.join(runs, [tree, "_part"]).withColumn("place", F.col("_at") + F.col("_add")).drop("_part", "_at", "_add")


def proofs(nodes: DataFrame, tree: str, block: int = 1 << 12) -> DataFrame:
    """nodes (tree, place, n, digest and others) with ``proof`` (siblings up to their tree's root, lowest first) and ``top`` (that root)."""
    if block < 2 or block & (block - 1):
        raise ValueError("block must be a power of two")
    levels = block.bit_length() - 1
    names = [c for c in nodes.columns if c != "_block"]
    size = nodes.agg(F.max("n")).first()[0] or 0
    schema = StructType([*nodes.select(*names).schema.fields]).add("_block", "long").add("_own", "binary").add("_top", "binary").add("_is_top", "boolean")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            """A block's leaves with their siblings, and a row for the block itself."""
            t = pa.Table.from_batches(held).combine_chunks()
            n = t.column("n")[0].as_py()
            top, own = climb(t.column("digest").to_pylist(), min(levels, (n - 1).bit_length()))
            t = t.append_column("_own", pa.array(own, pa.binary())).append_column("_top", pa.nulls(len(own), pa.binary())).append_column("_is_top", pa.array([False] * len(own)))
            first = t.slice(0, 1).set_column(t.schema.get_field_index("_top"), "_top", pa.array([top], pa.binary()))
            first = first.set_column(t.schema.get_field_index("_is_top"), "_is_top", pa.array([True]))
            return pa.concat_tables([t, first]).combine_chunks().to_batches()[0]

        for batch in batches:
            keys = list(zip(batch.column(names.index(tree)).to_pylist(), batch.column(len(names)).to_pylist(), strict=True))
            start = 0
            for k in range(len(keys) + 1):
                if k < len(keys) and keys[k] == last:
                    continue
                if k > start:
                    held.append(batch.slice(start, k - start))
                if k < len(keys):
                    if held:
                        yield done()
                    held, last, start = [], keys[k], k
        if held:
            yield done()

    dealt = nodes.select(*names, F.shiftright("place", levels).alias("_block")).repartition(tree, "_block").sortWithinPartitions(tree, "_block", "place")
    walked = materialize(dealt.mapInArrow(walk, schema), "walked")
    leaves, tops = walked.filter("not _is_top"), walked.filter("_is_top")
    above = tops.select(tree, F.col("_block").alias("place"), F.shiftright(F.col("n") + (block - 1), levels).alias("n"), F.col("_top").alias("digest"))
    if size > block:
        above = proofs(above, tree, block).select(tree, F.col("place").alias("_block"), F.col("proof").alias("_above"), "top")
    else:
        above = above.select(tree, F.col("place").alias("_block"), F.lit(b"").alias("_above"), F.col("digest").alias("top"))
    return leaves.join(above, [tree, "_block"]).select(*names, F.concat("_own", "_above").alias("proof"), "top")


def manifest(docs: DataFrame, id_col: str = "doc_id", key_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: Column | None = None, block: int = 1 << 12) -> DataFrame:
    """One row per row of docs: id_col, key_col, leaf, subroot, root, proof (the siblings from the leaf up to root, joined), place and
    n (in its subtree), tree_place and trees (of its subtree among all), altered. Digests are binary.

    A leaf is made of ``columns`` in their order; a subtree of the leaves of one key, by ascending id, nulls first; rows of one id stand
    by their leaves, so repeated rows are all kept, and read alike whatever their order in the files. The subtrees' roots, null first, then by
    bytes, make the root. altered is a digest that a column expression yields for each row, such as a leaf of changed values, carried along.
    Null values have a sign of their own, an empty text another; a null key has a subtree. An empty table gives no rows. Texts count whole.
    """
    key = F.coalesce(F.concat(F.lit(":"), F.col(key_col).cast("string")), F.lit("-"))  # null is least
    rows = docs.select(
        F.col(id_col).alias("id"), key.alias("tree"), leaf_digest(*[F.col(c) for c in columns]).alias("digest"),
        (F.lit(None).cast("binary") if altered is None else altered).alias("altered"),
    )
    rows = materialize(rows, "digests")  # texts are read once: numbering looks at its rows twice
    leaves = proofs(numbered(rows, "tree", ["id", "digest"], "leaves"), "tree", block)
    subroots = leaves.filter("place = 0").select("tree", F.lit("").alias("all"), F.col("top").alias("digest"))
    upper = proofs(numbered(subroots, "all", ["tree"], "subroots"), "all", block)
    upper = upper.select("tree", F.col("place").alias("tree_place"), F.col("n").alias("trees"), F.col("proof").alias("_above"), F.col("top").alias("root"))
    return leaves.join(upper, "tree").select(
        F.col("id").alias(id_col), F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30)).cast(docs.schema[key_col].dataType).alias(key_col), F.col("digest").alias("leaf"),
        F.col("top").alias("subroot"), "root", F.concat("proof", "_above").alias("proof"), "place", "n", "tree_place", "trees", "altered",
    )


def folded(rows: DataFrame, leaf: str, into: str = "folded_root") -> DataFrame:
    """manifest() rows with the root that the digests in column ``leaf`` lead to with the rows' own proofs; equal to root where nothing
    was altered. Rows are worked on in place."""
    asked = rows.withColumn("_leaf", F.col(leaf))
    fields = asked.columns
    at = [fields.index(c) for c in ("_leaf", "proof", "place", "n", "tree_place", "trees")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in at]
            roots = [fold(leaf, proof, (place, n), (tree, trees)) for leaf, proof, place, n, tree, trees in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*fields, into])

    return asked.mapInArrow(run, StructType([*asked.schema.fields]).add(into, "binary")).drop("_leaf")


def verify_manifest(docs: DataFrame, id_col: str = "doc_id", key_col: str = "lang", size_col: str = "n_chars", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), every: int = 7, block: int = 1 << 12) -> DataFrame:
    """manifest() of docs and a test of its proofs: rows whose id's crc32 ``every`` divides are tampered with (size_col grows by one, a
    null stays as it is), and each row's leaf is folded with its proof. Adds ``folded_root`` and ``verified``: do they lead to the root?
    A row without an id is not tampered with. All else is as in manifest()."""
    changed = [F.col(c) + 1 if c == size_col else F.col(c) for c in columns]
    tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    altered = F.when(tampered & F.col(size_col).isNotNull(), leaf_digest(*changed))
    rows = manifest(docs, id_col, key_col, columns, altered, block)
    rows = folded(rows.withColumn("_seen", F.coalesce("altered", "leaf")), "_seen").drop("_seen")
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def digest_report(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """verify_manifest() rows with digests as lowercase hexadecimal text, and a proof as the digest of its siblings' text."""
    text = lambda c: F.lower(F.hex(c))
    return rows.select(id_col, *[text(c).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(text("proof").cast("binary"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), "verified")
