"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source has a queue of its documents' tokens. A round grants every queue its quantum, its share of a window; a queue spends its
grants in pieces of ``piece_tokens``, so what it cannot spend stays as a deficit for later rounds, whichever window or partition they
fall in. After r rounds queue s has therefore had min(total_s, piece * floor(r * quantum_s / piece)) tokens: the round of any token, and
its place among the tokens of all queues, follow from the token's place in its own queue by arithmetic. Windows are cut from that order
without gaps, so only the last is padded. A window holds window / piece_tokens pieces: more sources than that take turns over windows.

Queues are cut into blocks of about ``block_tokens`` of all queues' tokens, dealt by row, so that a source with a third of all rows is
spread like any other. A block's place in its queue comes from a running sum over the table of (queue, block); tokens are shuffled once.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize

END_ID = 1
#: Printable ASCII and the letters of Latin-1, whose normal form is themselves and whose lower case is one letter.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own runs, for these characters in lower case.
RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_signs = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: How byte-level vocabularies write bytes: printable Latin-1 as itself, the others in order from U+0100 on.
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _signs)}
_codes: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of words between ASCII white space, as little-endian unsigned 32-bit numbers. The tokenizer drops white space and lower-cases,
    so that words are encoded apart, A-Z as a-z, but for words that hold the start of a special token. Two generations of ``size`` words are kept."""

    def __init__(self, path: str, size: int = 300_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.size, self.longest = Tokenizer.from_file(path), size, longest
        self.now: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        self.packed = [x.to_bytes(4, "little") for x in range(self.tokenizer.get_vocab_size())]
        self.run = functools.lru_cache(20_000)(self._run)

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(BYTE_SIGNS)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(run)])

    def encoded(self, word: bytes) -> bytes:
        """The runs of a word of plain characters go to the model at once. All else goes through the whole tokenizer."""
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            text = text.lower()
            return self._run(text) if text.isalpha() else b"".join([self._run(x) if x.isalpha() else self.run(x) for x in RUNS.findall(text)])
        return b"".join([self.packed[x] for x in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def words(self, text: str) -> list[bytes]:
        plain = text.encode()
        return plain.lower().split() if b"<|" not in plain else [w if b"<|" in w else w.lower() for w in plain.split()]

    def of_texts(self, texts: list[str], most: int = 2_000_000) -> list[bytes]:
        """The ids of each text; texts are taken together up to about ``most`` characters."""
        out, start, size = [], 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= most or k + 1 == len(texts):
                out += self._together([self.words(t) for t in texts[start : k + 1]])
                start, size = k + 1, 0
        return out

    def _together(self, texts: list[list[bytes]]) -> list[bytes]:
        table, now, old = dict.fromkeys(set().union(*texts)), self.now, self.old
        new = []
        for w in table:
            if (ids := now.get(w)) is None:
                if (ids := old.get(w)) is None:
                    new.append(w)
                    continue
                now[w] = ids
            table[w] = ids
        table.update(fresh := {w: self.encoded(w) for w in new})
        now.update(fresh if max(map(len, new), default=0) <= self.longest else {w: ids for w, ids in fresh.items() if len(w) <= self.longest})
        if len(now) >= self.size:
            self.old, self.now = now, {}
        return [b"".join(map(table.__getitem__, words)) for words in texts]


def word_ids(tokenizer_file: str) -> WordIds:
    """One for each Python worker."""
    if tokenizer_file not in _codes:
        _codes[tokenizer_file] = WordIds(tokenizer_file)
    return _codes[tokenizer_file]


def token_ids(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per row: id, source, n (tokens with the end id), ids (binary, without the end id), row (tells rows apart). A null text is empty,
    a null source is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = word_ids(tokenizer_file).of_texts(batch.column(2).to_pylist())
            n = pa.array([len(x) // 4 + 1 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(ids, pa.binary())], ["id", "source", "n", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, source string, n bigint, ids binary")
    return ids.withColumn("row", F.monotonically_increasing_id())


class Rounds:
    """The closed form for queues of ``totals`` tokens with ``weights``; all places are exact integers."""

    def __init__(self, totals: list[int], weights: list[float], window: int, piece: int):
        self.totals, self.piece = np.array(totals, np.int64), piece
        w = np.maximum(1, np.round(np.array(weights) * ((1 << 20) / max(sum(weights), 1e-300)))).astype(np.int64)
        # grants after r rounds are r * unit // scale pieces, held as whole and part so that r * part stays below 2**63
        self.scale, self.unit = int(w.sum()) * piece, window * w
        self.whole, self.part = self.unit // max(self.scale, 1), self.unit % max(self.scale, 1)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sums(self, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that each queue has had after so many rounds, and their running sums from 0 on."""
        if (found := self.known.get(rounds)) is not None:
            return found
        if len(self.known) >= 256:
            self.known.clear()
        served = np.minimum(self.totals, (rounds * self.whole + rounds * self.part // self.scale) * self.piece)
        found = self.known[rounds] = served, np.concatenate([[0], np.cumsum(served)])
        return found

    def runs(self, queue: int, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """(first token, length, place of the first among all tokens) of the stretches of queue tokens [start, stop)."""
        unit = int(self.unit[queue])
        while start < stop:
            pieces = start // self.piece + 1
            r = -(-pieces * self.scale // unit)
            served, ahead = self.sums(r)
            behind = self.sums(r - 1)[1]
            end = min(stop, int(served[queue]))
            # queues before this one have had this round, those after it the one before
            yield start, end - start, int(ahead[queue] + behind[-1] - behind[queue + 1]) + start
            start = end


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = 2048, weights: dict[str, float] | None = None, piece_tokens: int = 256, block_tokens: int = 500_000) -> DataFrame:
    """Per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    weights: target proportion by source; without it each source's share of all tokens. Sources not named share what the named leave, in
    proportion to their tokens. When a queue runs out the others go on with their own quanta. Every token lies in one piece, an empty
    text's end id too. Repeated rows and rows without an id are packed once each, whatever their length; rows of one id stand in the
    order in which they were read. Other columns are not looked at. An empty table gives no pieces.
    """
    tokens = materialize(token_ids(docs, tokenizer_file, id_col, text_col, source_col), "tokens")
    own = {r.source: r.n for r in tokens.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    names, total = sorted(own), sum(own.values())
    target = [float(own[x]) for x in names]
    if weights:
        rest = sum(own[x] for x in names if x not in weights)
        left = max(1 - sum(weights.get(x, 0.0) for x in names), 0.01)
        target = [float(weights[x]) if x in weights else left * own[x] / rest for x in names]
    rounds = Rounds([own[x] for x in names], target, window, piece_tokens)
    queues = docs.sparkSession.sparkContext.broadcast({x: k for k, x in enumerate(names)})  # as many entries as sources
    blocks = max(1, total // block_tokens)
    dealt = tokens.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    sums = dealt.groupBy("source", "block").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sums.select("block", "source", F.lit(None).cast("bigint").alias("row"), F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), before.alias("n"), F.lit(None).cast("binary").alias("ids"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = at = 0
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(k).to_pylist() for k in range(1, 6)]
            for source, row, doc, n, ids in zip(*cols, strict=True):
                if row is None:  # a block's first row says where it stands in its queue
                    q, at = queues.value[source], n
                    continue
                ids += END_ID.to_bytes(4, "little")
                merged: list[list[int]] = []
                for first, length, pos in rounds.runs(q, at, at + n):
                    start = first - at
                    while length:  # cut at the window's end
                        fits = min(length, window - pos % window)
                        if merged and merged[-1][2] + merged[-1][1] == pos and pos % window:
                            merged[-1][1] += fits
                        else:
                            merged.append([start, fits, pos])
                        start, length, pos = start + fits, length - fits, pos + fits
                at += n
                out += [(doc, s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]), n, p // window, p % window, source) for s, m, p in merged]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], fields)

    id_type = docs.schema[id_col].dataType
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    kinds = [to_arrow_type(id_type), *[pa.int64()] * 6, pa.string()]
    schema = f"doc_id {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"
    ordered = first.unionByName(dealt.select("block", "source", "row", "id", "n", "ids")).repartition("block", "source").sortWithinPartitions("block", "source", F.asc_nulls_first("row"))
    return ordered.mapInArrow(place, schema).withColumnRenamed("doc_id", id_col)
