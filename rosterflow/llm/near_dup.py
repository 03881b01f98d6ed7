"""Near-duplicate classes by improved consistent weighted sampling, banding and weighted Jaccard verification.

Texts are lower-cased (A-Z) word sequences; texts with the same words are one node. A node's weighted set holds its five-word shingles
(all its words where there are fewer), weighted by their count times the mean inverse document frequency of their words. Document
frequencies are counted over all documents by word, not by shingle: a shingle's own frequency is mostly the size of the group of copies
that it belongs to, which would make a large group's texts look unlike. They are kept by the word's hash, in a table of fixed size.

Each of ``bands * rows`` samples picks one shingle of a set so that two sets pick the same with the probability of their weighted
Jaccard similarity. Nodes that agree on all samples of a band share a bucket. In a bucket, each node is compared with its leader: the
node that shares buckets with the most others (the text that copies were made from shares more than its copies do). Pairs whose samples
agree too rarely to be similar go; the others are verified on their whole weighted sets, and links make classes.

Buckets that hold more than one class then may hide links between members that never led. Their nodes are compared by prefix filtering,
which is exact: two sets above the threshold have a shingle in common among the rarest of either, and may not have too little left from
there on. A rare shingle's nodes are cut by the weights that a partner may have (``by_total``); those of its most frequent class meet
those of its other classes, in tiles of bounded size; what may have a partner there meets again with the whole sets, and is verified within
the tile, the most agreeing pairs first, until what is similar is of one class. A class is never compared with itself, and no list of a bucket's
pairs is made: a tile gives its rows and fewer links than it has classes.

A whole set takes several times the room of its text, so texts travel (``bodies``), and each task makes the sets that it needs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MembershipFilter, Spread, materialize, most_files

SHINGLE = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 16
#: Document frequencies are kept for 2**DF_BITS values of a word's hash: 2 MB whatever the vocabulary; words with one value share their sum.
DF_BITS = 18
TILE = 256
#: Totals of one band differ by this factor at most.
BAND = 1.125
#: Tables between steps have a file for so many bytes of texts, or two for each core.
FILE_BYTES = 8 << 20


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _node(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


class Sets:
    """Weighted shingle sets and their samples. idf: by the upper bits of a word's hash."""

    def __init__(self, idf: np.ndarray, samples: int, seed: int = 7):
        self.idf = idf
        rng = np.random.default_rng(seed)
        size = 1 << TABLE_BITS
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.beta = rng.random(size, np.float32)
        self.odd = rng.integers(0, 1 << 63, samples, np.uint64) << np.uint64(1) | np.uint64(1)

    def weighted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted shingle hashes and their weights."""
        n = len(words)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        idf = self.idf[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)]
        width = min(SHINGLE, n)
        m = n - width + 1
        shingle, weight = np.zeros(m, np.uint64), np.zeros(m)
        for k in range(width):
            shingle = shingle * MULTIPLIER + h[k : k + m]
            weight += idf[k : k + m]
        shingle ^= shingle >> np.uint64(29)
        shingle *= MULTIPLIER
        shingle ^= shingle >> np.uint64(32)
        order = np.argsort(shingle)
        shingle, weight = shingle[order], weight[order]
        new = np.ones(m, bool)
        np.not_equal(shingle[1:], shingle[:-1], out=new[1:])
        if new.all():
            return shingle, (weight / width).astype(np.float32)
        first = np.flatnonzero(new)
        return shingle[first], (weight[first] / width * np.diff(first, append=m)).astype(np.float32)

    def samples(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row of 32-bit samples for each set that is not empty."""
        k = np.concatenate([s[0] for s in sets])
        log_w = np.log(np.concatenate([s[1] for s in sets]))
        starts = np.cumsum([0, *[len(s[0]) for s in sets[:-1]]])
        low = k.astype(np.uint32) * np.uint32(0x85EBCA6B)
        out = np.empty((len(sets), len(self.odd)), np.uint32)
        shift, n = np.uint64(64 - TABLE_BITS), len(k)
        # all steps write into the same few arrays; the halves of a key are written in place
        h, key, t_int, sign = np.empty(n, np.uint64), np.empty(n, "<i8"), np.empty(n, np.int32), np.empty(n, np.int32)
        at, upper, lower = h.view(np.int64), key.view("<i4")[1::2], key.view("<u4")[::2]
        r, beta, log_a, t = (np.empty(n, np.float32) for _ in range(4))
        for j, odd in enumerate(self.odd):
            np.multiply(k, odd, out=h)
            np.right_shift(h, shift, out=h)
            for table, held in ((self.r, r), (self.beta, beta), (self.log_c, log_a)):
                np.take(table, at, out=held, mode="clip")
            np.divide(log_w, r, out=t)
            t += beta
            np.floor(t, out=t)
            t_int[:] = t
            # log_a = log_c - r * (t - beta + 1)
            t -= beta
            t += np.float32(1)
            t *= r
            log_a -= t
            # the least log_a first; the sample is the shingle and its t, which also settles ties
            bits = log_a.view(np.int32)
            np.right_shift(bits, 31, out=sign)
            sign &= 0x7FFFFFFF
            np.bitwise_xor(bits, sign, out=upper)
            np.bitwise_xor(low, t_int.view(np.uint32) * np.uint32(0xC2B2AE35), out=lower)
            out[:, j] = np.minimum.reduceat(key, starts).astype(np.uint32)
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima."""
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = float(np.minimum(a[1][at[same]], b[1][same]).sum())
    total = float(a[1].sum()) + float(b[1].sum()) - both
    return both / total if total else 1.0


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by slot; the bytes of all texts stand in the slot after the last."""
    counts, shift = np.zeros((1 << DF_BITS) + 1, np.int64), np.uint64(64 - DF_BITS)
    for batch in batches:
        counts[-1] += pc.sum(pc.binary_length(batch.column(0))).as_py() or 0
        for text in batch.column(0):
            words = set(_words(text.as_py()))
            h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            counts[np.unique((h >> shift).astype(np.int64))] += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "df"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """1 + log((documents + 1) / (df + 1)) by the upper DF_BITS of a word's hash; df counts the documents that hold a word of that value."""
    return frequencies_and_size(texts)[0]


def frequencies_and_size(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The inverse frequencies, and the bytes of all texts."""
    n_docs = texts.count()
    counts = texts.select("text").mapInArrow(_document_frequencies, "slot bigint, df bigint").groupBy("slot").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros((1 << DF_BITS) + 1)
    df[counts.column("slot").to_numpy()] = counts.column("df").to_numpy()
    return (1 + np.log((n_docs + 1) / (df[:-1] + 1))).astype(np.float32), int(df[-1])


def components(links: DataFrame, files: int) -> DataFrame:
    """node, label: the least node of its component. links: a, b. Labels take their neighbours' least, then that label's own label.
    Hubs and the labels of large components are spread over the tasks. Tables between steps have ``files`` files at most."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(files), "edges")
    degrees = materialize(both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m")).coalesce(files), "degrees")
    hubs = Spread(degrees, "a")
    labels = materialize(degrees.select(F.col("a").alias("node"), F.least("a", "m").alias("label")).coalesce(files), "labels")
    edges = both.select(F.col("a").alias("to"), F.col("b").alias("node"))
    while True:
        near = hubs.join(edges, labels, "node", by="to").groupBy("to").agg(F.min("label").alias("near"))
        step = materialize(labels.join(near.withColumnRenamed("to", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")).coalesce(files), "labels")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        large = Spread(step.groupBy("label").agg(F.count("*").alias("n")), "label")
        new = materialize(large.join(step, jump, "label", by="node").select("node", "was", F.least("label", "further").alias("label")).coalesce(files), "labels")
        labels = new.select("node", "label")
        if new.filter("label < was").isEmpty():
            return labels


def rare_prefixes(bodies: DataFrame, whole: DataFrame, idf: Broadcast, threshold: float, files: int) -> DataFrame:
    """Buckets (key, node, label, behind, total) by rare shingles, of texts with node, words; whole: node, label, total. Of each text's set,
    from the rarest on, the shingles that stand before the last ``threshold`` of its weight. The first shingle that two sets above the
    threshold have in common is among these in both, and what they have in common weighs no more than what stands from there on
    (``behind``) in either."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(idf.value, 1)
        for batch in batches:
            for node, words in zip(batch.column(0), batch.column(1), strict=True):
                k, w = sets.weighted(words.as_py().split())
                same = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(k), np.int32)), pa.array([node.as_py()], pa.binary())).dictionary_decode()
                yield pa.RecordBatch.from_arrays([same, pa.array(k.view(np.int64)), pa.array(w)], ["node", "key", "weight"])

    # what a set has once does not travel with each of its shingles: it meets them again where they are by node
    each = materialize(bodies.select("node", "words").mapInArrow(rows, "node binary, key bigint, weight float").coalesce(files), "shingles")
    # a shingle of one set is the rarest there is, and makes no pair
    shared = materialize(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").coalesce(files), "frequencies")
    each = Spread(shared, "key").join(each, shared, "key", by="node")
    behind = F.sum(F.col("weight").cast("double")).over(Window.partitionBy("node").orderBy(F.desc("n"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0))
    each = each.select("key", "node", behind.alias("behind")).join(whole, "node").filter(F.col("behind") >= (threshold - 1e-6) * F.col("total"))
    return materialize(each.select("key", "node", "label", "behind", "total").coalesce(files), "prefixes")


def by_total(prefixes: DataFrame, threshold: float) -> DataFrame:
    """The buckets of rare_prefixes, each cut by total weight: key, node, label, behind, total, small, large.

    What two sets share weighs at least threshold / (1 + threshold) of their totals together, and no more than what is behind in
    either. So the lighter of a pair reaches totals up to ``behind`` over that share, less its own; a set whose reach ends below its own
    total is the heavier one of each of its pairs. Totals fall into bands. A set is large in its own band, and small in all bands from
    its own to that of its reach, which are four at most. A pair above the threshold meets in the heavier one's band."""
    reach = F.col("behind") / (threshold / (1 + threshold) - 1e-6) - F.col("total")
    band = lambda x: F.floor(F.log(x) / math.log(BAND))
    small = F.col("_reach") >= F.col("total") * (1 - 1e-9)
    cut = prefixes.withColumn("_reach", reach).withColumns({"small": small, "_home": band("total")})
    cut = cut.withColumn("_band", F.explode(F.sequence("_home", F.when(F.col("small"), F.greatest("_home", band(F.col("_reach") * (1 + 1e-9)))).otherwise(F.col("_home")))))
    return cut.select(F.xxhash64("key", "_band").alias("key"), "node", "label", "behind", "total", "small", (F.col("_band") == F.col("_home")).alias("large"))


def tiles(buckets: DataFrame, samples: DataFrame, files: int | None = None) -> DataFrame:
    """Rows of tiles of about TILE by TILE, each with key, i, j, lead, node, label, behind, total, samples: in each bucket the small nodes
    (``lead``) of all classes but its most frequent meet every large node, and those of the most frequent class the large ones of others."""
    count = lambda c: F.count_if(c)
    by_class = buckets.groupBy("key", "label").agg(F.count("*").alias("c"), count(F.col("small")).alias("s"), count(F.col("large")).alias("l"))
    stats = by_class.groupBy("key").agg(F.sum("c").alias("n"), F.sum("s").alias("s"), F.sum("l").alias("l"), F.count("*").alias("classes"), F.max_by(F.struct("label", "s", "l"), F.struct("c", "label")).alias("main"))
    stats = stats.filter("classes > 1 and s > 0 and l > 0")
    # leads and others of both kinds of tiles: 0, small ones of other classes; 1, those of the most frequent class
    stats = stats.select("key", "n", F.col("main.label").alias("main"), (F.col("s") - F.col("main.s")).alias("s0"), F.col("l").alias("l0"), F.col("main.s").alias("s1"), (F.col("l") - F.col("main.l")).alias("l1"))
    stats = materialize(stats.coalesce(files) if files else stats, "prefix_sizes")
    rows = Spread(stats, "key").join(buckets, stats, "key", by="node").join(samples, "node")
    deal = lambda part, n: F.pmod(F.xxhash64("node", F.lit(part)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    names = ["key", "i", "j", "lead", "node", "label", "behind", "total", "samples"]
    main, out = F.col("label") == F.col("main"), []
    for kind, lead, other in ((0, ~main, F.lit(True)), (1, main, ~main)):
        wide, long = F.ceil(F.col(f"s{kind}") / TILE), F.ceil(F.col(f"l{kind}") / TILE)
        met = rows.filter((F.col(f"s{kind}") > 0) & (F.col(f"l{kind}") > 0))
        leads = met.filter(F.col("small") & lead).withColumns({"lead": F.lit(True), "_i": deal(1, wide), "j": every(long)})
        others = met.filter(F.col("large") & other).withColumns({"lead": F.lit(False), "j": deal(2, long), "_i": every(wide)})
        out += [x.withColumn("i", F.col("_i") * 2 + kind).select(names) for x in (leads, others)]
    return in_tiles(reduce(DataFrame.unionByName, out))


def in_tiles(rows: DataFrame) -> DataFrame:
    """Rows of one tile in one task and in a row, leads before the others."""
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("lead"), "node")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width, a row of bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _tile_columns(rows: pa.RecordBatch, n_samples: int) -> tuple[np.ndarray, ...]:
    """label, behind, total, samples of a tile's rows."""
    return _fixed(rows.column(5), 16), rows.column(6).to_numpy(), rows.column(7).to_numpy(), _fixed(rows.column(8), 4 * n_samples).view(np.uint32)


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """Leads and others of each tile that has both, from rows that stand as in_tiles leaves them."""
    tile, held = None, ([], [])

    def whole() -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
        if held[0] and held[1]:
            yield tuple(pa.Table.from_batches(x).combine_chunks().to_batches()[0] for x in held)

    for batch in batches:
        if not batch.num_rows:
            continue
        place, lead = np.stack([batch.column(c).to_numpy() for c in range(3)], 1), batch.column(3).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1) | (lead[1:] != lead[:-1])) + 1), len(place)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if (at := tuple(place[start])) != tile:
                yield from whole()
                tile, held = at, ([], [])
            held[0 if lead[start] else 1].append(batch.slice(start, stop - start))
    yield from whole()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 14, rows: int = 3) -> DataFrame:
    """One row per row of docs: id_col, class_id (the least id of its class), class_size, n_links (verified links of its text to other
    texts, of those that its class is made from), kept (its id is the class's).

    A null text is empty; texts without words are equal to each other and to nothing else. Repeated rows belong to one class, and each
    counts in its size. Of equal degrees the larger node leads, of equal shares the larger label; neither changes the classes. Texts go
    in whole, whatever their length. Other columns are not read, and may have any names. An empty table gives an empty result.
    Two texts at the threshold share a bucket with a probability of 1 - (1 - threshold**rows)**bands.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    id_kind = id_type.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    idf, size = frequencies_and_size(texts)
    sent, files = spark.sparkContext.broadcast(idf), most_files(spark, size, FILE_BYTES)
    n_samples = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(sent.value, n_samples)
        known: dict[bytes, tuple[bytes, float]] = {}  # copies in one task are signed once
        waiting: dict[bytes, tuple] = {}

        def flush() -> None:
            if waiting:
                for node, sample in zip(waiting, sets.samples(list(waiting.values())), strict=True):
                    known[node] = sample.tobytes(), float(waiting[node][1].astype(float).sum())
                waiting.clear()

        for batch in batches:
            nodes, size = [], 0
            for text in batch.column(1):
                words = _words(text.as_py())
                node = _node(words)
                nodes.append(node)
                if words and node not in known and node not in waiting:
                    waiting[node] = sets.weighted(words)
                    size += len(words)
                    if size > 60_000:
                        flush()
                        size = 0
                elif not words:
                    known[node] = b"", 0.0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), *(pa.array([known[n][c] for n in nodes], t) for c, t in ((0, pa.binary()), (1, pa.float64())))], ["id", "node", "samples", "total"])
            if len(known) > 20_000:
                known.clear()

    signed = materialize(texts.mapInArrow(sign, f"id {id_kind}, node binary, samples binary, total double").coalesce(files), "signed")
    # equal texts meet here, after each task has brought its own together
    nodes = materialize(signed.groupBy("node").agg(F.min(F.struct("id", "samples", "total")).alias("x"), F.count("*").alias("n")).select("node", "x.id", "x.samples", "x.total", "n").coalesce(files), "nodes")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [k for k, x in enumerate(batch.column(1).to_pylist()) if x]
            values = _fixed(batch.column(1).take(pa.array(keep, pa.int64())), 4 * n_samples).view(np.uint32)
            keys = np.empty((len(keep), bands), np.uint64)
            for b in range(bands):
                key = np.full(len(keep), b + 1, np.uint64)
                for c in range(rows):
                    key = (key ^ values[:, b * rows + c].astype(np.uint64)) * MULTIPLIER
                    key ^= key >> np.uint64(31)
                keys[:, b] = key
            node = batch.column(0).take(pa.array(np.repeat(keep, bands), pa.int64()))
            yield pa.RecordBatch.from_arrays([node, pa.array(keys.view(np.int64).ravel())], ["node", "key"])

    placed = nodes.select("node", "samples").mapInArrow(buckets, "node binary, key bigint")
    sizes = materialize(placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").coalesce(files), "bucket_sizes")
    by_key = Spread(sizes, "key")
    shared = by_key.join(placed, sizes, "key", by="node")
    shared = materialize(shared.withColumn("degree", F.sum("n").over(Window.partitionBy("node"))).select("key", "node", "degree").coalesce(files), "buckets")
    # whole texts, of the first row of each node that shares a bucket
    wanted = materialize(nodes.join(shared, "node", "left_semi").select("node", "id", "samples", "total").coalesce(files), "wanted")
    sieve = MembershipFilter(wanted, "id")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, out = 0, 0, []
            for text in batch.column(1):
                words = _words(text.as_py())
                if words:
                    out.append((_node(words), b" ".join(words)))
                    size += len(out[-1][1])
                at += 1
                if size > 4_000_000 or at == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.binary()) for c in range(2)], ["node", "words"])
                    size, out = 0, []

    by_id = sieve.mark(texts, "id", "maybe").filter("maybe").select("id", "text")
    bodies = materialize(by_id.mapInArrow(whole, "node binary, words binary").groupBy("node").agg(F.first("words").alias("words")).coalesce(files), "bodies")
    # samples of similar sets agree in threshold * n of n cases; far fewer than that would be 4 standard deviations away
    least = max(1, math.floor(n_samples * threshold - 4 * math.sqrt(n_samples * threshold * (1 - threshold))))
    samples = wanted.select("node", "samples")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_fixed(batch.column(c), 4 * n_samples).view(np.uint32) for c in (4, 5))
            mask = pa.array((a == b).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in range(4)], ["a", "b", "la", "lb"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, lead = Sets(sent.value, 1), None
        for batch in batches:
            similar, (b, a, words) = [], (batch.column(c) for c in (0, 2, 5))
            for x in range(batch.num_rows):
                one = sets.weighted(words[x].as_py().split())
                if not a[x].is_valid:
                    lead = one
                similar.append(a[x].is_valid and similarity(lead, one) >= threshold)
            mask = pa.array(similar, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in (a, b, batch.column(3), batch.column(4))], ["a", "b", "la", "lb"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, la, lb) that are similar. b's text goes to a task once, before the texts of all the a."""
        pairs = materialize(pairs.coalesce(files), "pairs")
        spread = Spread(pairs.groupBy("b").agg(F.count("*").alias("n")), "b")
        x = spread.join(pairs, samples.select(F.col("node").alias("b"), F.col("samples").alias("sb")), "b", by="a")
        x = x.join(samples.select(F.col("node").alias("a"), F.col("samples").alias("sa")), "a")
        fit = materialize(x.select("a", "b", "la", "lb", "sa", "sb").mapInArrow(agree, "a binary, b binary, la binary, lb binary").coalesce(files), "fit")
        names = ["b", "_part", "a", "la", "lb", "node"]
        members = spread.many(fit, "b", by="a").withColumn("node", F.col("a"))
        first = spread.one(fit.select("b").distinct(), "b").withColumns({c: F.lit(None).cast("binary") for c in ("a", "la", "lb")} | {"node": F.col("b")})
        x = first.select(names).unionByName(members.select(names)).join(bodies, "node").select(*names[:-1], "words")
        x = x.repartition("b", "_part").sortWithinPartitions("b", "_part", F.asc_nulls_first("a"))
        return materialize(x.mapInArrow(verify, "a binary, b binary, la binary, lb binary").coalesce(4 * files), "links")

    leaders = shared.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top")).select("key", F.col("top.node").alias("b"))
    pairs = by_key.join(shared.select("key", F.col("node").alias("a")), leaders, "key", by="a").filter("a != b").select("a", "b").distinct()
    links = verified(pairs.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb")))
    classes = components(links, files)
    label = F.coalesce("label", "node").alias("label")

    labelled = materialize(shared.select("key", "node").join(classes, "node", "left").select("key", "node", label).coalesce(files), "labelled")
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    crowd = materialize(by_key.join(labelled, several, "key", by="node").select("node", "label").distinct().coalesce(files), "crowd")
    if not crowd.isEmpty():

        shape = "key bigint, i bigint, j bigint, lead boolean, node binary, label binary, behind double, total double, samples binary"
        share = threshold / (1 + threshold) - 1e-6

        def pairs_within(leads: pa.RecordBatch, others: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places of leads and of others that may be similar and are of different classes, and on how many samples they agree."""
            lab, beh, tot, sam = _tile_columns(leads, n_samples)
            found = []
            for x in range(0, others.num_rows, TILE):
                lab2, beh2, tot2, sam2 = _tile_columns(others.slice(x, TILE), n_samples)
                able = np.minimum.outer(beh, beh2) >= share * np.add.outer(tot, tot2)
                able &= np.less_equal.outer(tot, tot2)
                able &= (lab[:, None, :] != lab2[None, :, :]).any(2)
                one, two = np.nonzero(able)
                for k in range(0, len(one), 50_000):
                    o, t = one[k : k + 50_000], two[k : k + 50_000]
                    agreed = (sam[o] == sam2[t]).sum(1)
                    fit = agreed >= least
                    found.append((o[fit], t[fit] + x, agreed[fit]))
            return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each tile the rows that may have a partner in it."""
            for leads, others in _by_tile(batches):
                one, two, _ = pairs_within(leads, others)
                if len(one):
                    yield leads.take(pa.array(np.unique(one)))
                    yield others.take(pa.array(np.unique(two)))

        def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Links that make one class of several within a tile. The pairs that agree most come first; what they have made one class of
            is not compared again, so a tile has fewer links than classes."""
            sets = Sets(sent.value, 1)
            for leads, others in _by_tile(batches):
                one, two, agreed = pairs_within(leads, others)
                made: dict[bytes, tuple] = {}

                def of(rows: pa.RecordBatch, x: int) -> tuple[np.ndarray, np.ndarray]:
                    if (node := rows.column(4)[x].as_py()) not in made:  # noqa: B023
                        made[node] = sets.weighted(rows.column(9)[x].as_py().split())  # noqa: B023
                    return made[node]  # noqa: B023

                labels = [x.column(5).to_pylist() for x in (leads, others)]
                top = {x: x for each in labels for x in each}
                out = []
                for x in np.argsort(-agreed, kind="stable"):
                    o, t = one[x], two[x]
                    ends = []
                    for y in (labels[0][o], labels[1][t]):
                        while top[y] != y:
                            top[y] = y = top[top[y]]
                        ends.append(y)
                    if ends[0] != ends[1] and similarity(of(leads, o), of(others, t)) >= threshold:
                        top[ends[0]] = ends[1]
                        # of equal totals both may lead: the larger node comes first in either case
                        out.append(max((n := leads.column(4)[o].as_py(), labels[0][o], m := others.column(4)[t].as_py(), labels[1][t]), (m, labels[1][t], n, labels[0][o])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.binary()) for c in (0, 2, 1, 3)], ["a", "b", "la", "lb"])

        marked = MembershipFilter(crowd, "node", bits=22)
        prefixes = rare_prefixes(marked.mark(bodies, "node", "maybe").filter("maybe"), crowd.join(wanted.select("node", "total"), "node"), sent, threshold, files)
        partners = materialize(tiles(by_total(prefixes, threshold), samples, files).mapInArrow(met, shape).coalesce(4 * files), "partners")
        with_words = in_tiles(partners.join(bodies, "node").select(*partners.columns, "words"))
        more = materialize(with_words.mapInArrow(united, "a binary, b binary, la binary, lb binary").distinct().coalesce(4 * files), "links")
        links = links.unionByName(more)
        joined = components(more.select(F.col("la").alias("a"), F.col("lb").alias("b")), files).select(F.col("node").alias("label"), F.col("label").alias("least"))
        # a node without a link so far is a class of its own
        classes = classes.unionByName(joined.select(F.col("label").alias("node"), "label").join(classes, "node", "left_anti"))
        classes = Spread(classes.groupBy("label").agg(F.count("*").alias("n")), "label").join(classes, joined, "label", by="node", how="left").select("node", F.coalesce("least", "label").alias("label"))
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    of_node = materialize(nodes.select("node", "id", "n").join(classes, "node", "left").join(ends, "node", "left").select("node", "id", "n", label, F.coalesce("n_links", F.lit(0)).alias("n_links")).coalesce(files), "labels")
    of_class = materialize(of_node.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("nodes")).coalesce(files), "classes")
    of_node = Spread(of_class, "label", "nodes").join(of_node, of_class, "label", by="node").select("node", "class_id", "class_size", "n_links")
    return Spread(nodes, "node").join(signed.select("id", "node"), of_node, "node", by="id").select(
        F.col("id").alias(id_col), "class_id", "class_size", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    ).coalesce(files)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class, all columns kept. Only rows that may be in a class of several are shuffled."""
    found = near_duplicates(docs, id_col, text_col, **options).filter("class_size > 1").select(F.col(id_col).alias("_id"), "kept")
    found = materialize(found, "classes")
    sieve = MembershipFilter(found, "_id")
    row = sieve.mark(docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id")), "_id", "_maybe")
    alone = row.filter("not _maybe").select("_row.*")
    rest = row.filter("_maybe").join(found.groupBy("_id").agg(F.max("kept").alias("_kept")), "_id", "left")
    outside = rest.filter("_kept is null").select("_row.*")
    leaders = rest.filter("_kept").dropDuplicates(["_id"]).select("_row.*")
    return alone.unionByName(outside.unionByName(leaders).coalesce(most_files(docs.sparkSession, found.count(), 1_000)))
