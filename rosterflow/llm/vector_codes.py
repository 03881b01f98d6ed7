"""Short codes for vectors: every part of a vector becomes the index of its nearest codebook entry, found and refined by Lloyd's rounds with
Yinyang bounds, in exact integers.

Components are scaled to integers. Each part's codebook entries are clustered into groups once. A vector keeps, for each part, its entry
and one lower bound per group on the distance to the group's other entries. When entries have moved, bounds shrink by the farthest move in
their group; only groups whose bound no longer exceeds the distance to the vector's own entry are scanned. Scans use floating point, and
all entries within its error of the least are compared again in integers, so that ties go to the lowest index. Bounds are kept in half
precision, rounded down, which costs some scans and changes no result.

A pass maps the stored vectors in place and writes them with their new state beside each task's sums by part and entry; only these sums
are shuffled, and what reaches the driver is one row per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Spread, materialize

#: Over the error of a distance in double precision, as a share of the numbers that it is made of.
SLACK = 1e-12


def groups_of(entries: np.ndarray, count: int) -> np.ndarray:
    """The group of each of a part's entries, by a few rounds of k-means from evenly spaced entries."""
    points = entries.astype(np.float64)
    centres = points[np.linspace(0, len(points) - 1, count).astype(int)]
    for _ in range(5):
        near = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([points[near == g].mean(axis=0) if (near == g).any() else centres[g] for g in range(count)])
    return near


def halves_down(x: np.ndarray) -> np.ndarray:
    """Half precision, never above x."""
    out = np.minimum(x, 65000.0).astype(np.float16)
    return np.where(out.astype(np.float64) > x, np.nextafter(out, np.float16(0)), out)


class Books:
    """The codebooks of all parts with their groups, and how far entries have moved since the state was made."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray, count: int, moved: np.ndarray | None = None):
        self.entries, self.groups, self.count = entries, groups, count
        parts = len(entries)
        moved = np.zeros(entries.shape[:2]) if moved is None else moved
        self.members = [[np.flatnonzero(groups[p] == g) for g in range(count)] for p in range(parts)]
        self.drift = np.array([[moved[p][m].max() if len(m) else 0.0 for m in self.members[p]] for p in range(parts)]) * (1 + 1e-9)

    def next(self, entries: np.ndarray) -> Books:
        moved = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2))
        return Books(entries, self.groups, self.count, moved)

    def assign(self, x: np.ndarray, p: int, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of rows x in part p, its squared distance, and the new bounds. own: each row's entry so far; bounds: a
        column for each group, at most the distance to its entries other than own."""
        entries, n = self.entries[p], len(x)
        was = ((x - entries[own]) ** 2).sum(axis=1)
        reach = np.sqrt(was.astype(np.float64)) * (1 + 1e-9)
        bounds = np.maximum(bounds - self.drift[p], 0.0)
        best, least = own.copy(), was.copy()
        first, second = np.full(bounds.shape, -1), np.zeros(bounds.shape)
        nearest = np.zeros(bounds.shape, np.int64)
        for g, members in enumerate(self.members[p]):
            rows = np.flatnonzero(bounds[:, g] <= reach) if len(members) else np.zeros(0, int)
            if len(rows):
                entry, distance, other = scan(x[rows], entries[members])
                entry = members[entry]
                first[rows, g], nearest[rows, g], second[rows, g] = entry, distance, other
                better = (distance < least[rows]) | ((distance == least[rows]) & (entry < best[rows]))
                best[rows[better]], least[rows[better]] = entry[better], distance[better]
        scanned, is_best = first >= 0, first == best[:, None]
        near = np.sqrt(nearest.astype(np.float64)) * (1 - 1e-9)
        bounds = np.where(scanned, np.where(is_best, second, near), bounds)
        # a group that was not scanned has the entry that a row left among its others from now on
        left = np.flatnonzero(best != own)
        home = self.groups[p][own[left]]
        old = np.sqrt(was[left].astype(np.float64)) * (1 - 1e-9)
        bounds[left, home] = np.where(scanned[left, home], bounds[left, home], np.minimum(bounds[left, home], old))
        return best, least, bounds


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the nearest entry, the lowest of equals, its exact squared distance, and at most the distance to any other entry."""
    xf, cf = x.astype(np.float64), entries.astype(np.float64)
    square_x, square_c = (xf**2).sum(axis=1), (cf**2).sum(axis=1)
    rough = square_x[:, None] + square_c - 2 * (xf @ cf.T)
    slack = SLACK * (square_x + square_c.max())
    at, which = np.nonzero(rough <= (rough.min(axis=1) + 2 * slack)[:, None])
    exact = ((x[at] - entries[which]) ** 2).sum(axis=1)
    order = np.lexsort((which, exact, at))
    order = order[np.unique(at[order], return_index=True)[1]]
    entry = which[order]
    rough[np.arange(len(x)), entry] = np.inf
    return entry, exact[order], np.sqrt(np.maximum(rough.min(axis=1) - slack, 0.0))


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def assign_all(books: Books, x: np.ndarray, own: np.ndarray, bounds: np.ndarray, step: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Books.assign() over all parts: entries and bounds by row and part, and each row's squared distances summed."""
    parts = len(books.entries)
    wide = x.shape[1] // parts
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(books.entries).max()))
    if x.shape[1] * (2 * largest) ** 2 >= 2**63:
        raise ValueError("scaled components are too large for squared distances of 64 bits")
    best, error, new = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64), np.empty(bounds.shape)
    for start in range(0, len(x), step):
        rows = slice(start, start + step)
        for p in range(parts):
            best[rows, p], least, new[rows, p] = books.assign(x[rows, p * wide : (p + 1) * wide], p, own[rows, p], bounds[rows, p])
            error[rows] += least
    return best, error, new


def refine(vectors: DataFrame, books: Books, width: int, name: str) -> tuple[DataFrame, np.ndarray]:
    """One round: vectors (id, label, x, and own and bounds after the first round) with new own and bounds, and the moved entries."""
    parts, entries, wide = books.entries.shape
    started = "own" in vectors.columns
    schema = T.StructType([*vectors.select("id", "label", "x").schema.fields])
    for column, kind in (("own", T.BinaryType()), ("bounds", T.BinaryType()), ("entry", T.IntegerType()), ("n", T.LongType()), ("sums", T.ArrayType(T.LongType()))):
        schema = schema.add(column, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, wide), np.int64)
        kinds = None
        for batch in batches:
            kinds = batch.schema
            x = matrix(batch, "x", width)
            if started:
                own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(len(x), parts).astype(np.int64)
                bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float16).reshape(len(x), parts, books.count).astype(np.float64)
            else:
                own, bounds = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts, books.count))
            own, _, bounds = assign_all(books, x, own, bounds)
            places = (own + np.arange(parts) * entries).ravel()
            n += np.bincount(places, minlength=len(n))
            np.add.at(sums, places, x.reshape(-1, wide))
            nulls = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            state = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (own.astype(np.uint8), halves_down(bounds))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "label", "x")], *state, *nulls], schema.names)
        if kinds is not None:
            used = np.flatnonzero(n)
            nulls = [pa.nulls(len(used), kinds.field(c).type) for c in ("id", "label", "x")] + [pa.nulls(len(used), pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], schema.names)

    out = materialize(vectors.mapInArrow(run, schema), name)
    totals = out.filter("entry is not null").groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(wide)])
    moved = books.entries.copy().reshape(-1, wide)
    for row in totals.collect():  # a row for each entry
        moved[row.entry] = [row[f"s{k}"] // row.n for k in range(wide)]
    return out.filter("entry is null").drop("entry", "n", "sums"), moved.reshape(books.entries.shape)


def encode_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """One row per kept row of rows: id, label, code (a byte for each part), error (squared distances summed over the parts), and the final
    codebooks by part, entry and component.

    A row whose vector is null or holds null, infinite or undefined components is dropped. Components become floor(scale * x). A part's
    codebook begins as the part of the vectors with the ``entries`` smallest ids, ties by the vectors themselves, rows without an id last;
    with fewer vectors it has fewer entries. Each round assigns all parts, ties to the lowest index, and moves each entry to its parts' mean,
    rounded down; an entry without parts stays. All vectors have one length: that of most of the first ones; a row with another length has
    a null code and error. Repeated rows count each. An empty table gives no rows and no codebooks. Other columns are not looked at.
    """
    if entries > 256:
        raise ValueError("a code has one byte for each part")
    x = F.col(vector_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    kept = rows.filter(x.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), ints.alias("x"))
    first = smallest(kept, entries)
    if not first:
        return kept.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error")), np.zeros((parts, 0, 0), np.int64)
    lengths = [len(r.x) for r in first]
    width = max(set(lengths), key=lambda w: (lengths.count(w), w))
    if not width or width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    same = kept.filter(F.size("x") == width)
    if len(set(lengths)) > 1:
        first = smallest(same, entries)
    start = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1).copy()
    count = max(1, len(first) // 10)
    books = Books(start, np.stack([groups_of(part, count) for part in start]), count)
    state = same
    for k in range(rounds):
        state, moved = refine(state, books, width, f"round-{k}")
        books = books.next(moved)
    started = rounds > 0

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, "x", width)
            own, bounds = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts, count))
            if started:
                own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(len(x), parts).astype(np.int64)
                bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float16).reshape(len(x), parts, count).astype(np.float64)
            code, error, _ = assign_all(books, x, own, bounds)
            codes = pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), codes, pa.array(error)], ["id", "label", "code", "error"])

    schema = T.StructType([*kept.select("id", "label").schema.fields]).add("code", "binary").add("error", "long")
    others = kept.filter(F.size("x") != width).select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return materialize(state.mapInArrow(finish, schema).unionByName(others), "codes"), books.entries


def smallest(kept: DataFrame, entries: int) -> list:
    """The rows of the smallest ids, as many as a codebook has entries."""
    return kept.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()


def code_report(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """encode_vectors() with codes and the codebooks' digest as lowercase hexadecimal text, and ``label_error``, the errors summed over the
    rows of one label; null is a label too, with its own sum."""
    codes, books = encode_vectors(rows, id_col, vector_col, label_col, **settings)
    key = F.coalesce(F.concat(F.lit(":"), F.col("label").cast("string")), F.lit("-"))
    codes = codes.withColumn("_key", key)
    sums = codes.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = Spread(sums, "_key").join(codes, sums.drop("n"), "_key", by="id")
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
