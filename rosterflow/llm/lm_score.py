"""Document scores from a subword lattice.

A word's segmentations into the pieces of an existing vocabulary are weighted by unigram scores, and forward recursion in log space adds
up all of them. The vocabulary's own scores (a merge vocabulary has ranks, which Zipf's law turns into log-probabilities) are the prior;
how often the vocabulary's own encoding uses each piece in the distinct words of training brings them to the corpus. Pieces do not run
past word starts, so a document's lattice is its words' lattices in a row and its marginal probability their product; the recursion
runs once for each distinct word of the corpus. A document ends with the probability that training gives to ends among its tokens.

Word counts are made in bounded tables within the tasks and added up by word. The most frequent words (at most ``head``, each of at
most 64 bytes) are sent to all tasks; all others meet their scores in a join on the word, by (document, word), where longer words that
many documents hold are spread.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spread, fold_of, head_of, materialize

END = b""  # no word is empty: the key of the end token
HELD_OUT_FOLDS = 10
_models: dict[str, sentencepiece.SentencePieceProcessor] = {}


class Lattice:
    """Marginal log10-probability of a word under unigram pieces. uses: how often training's distinct words use each piece."""

    def __init__(self, model_file: str, uses: dict[str, int], prior: float = 1000.0):
        self.model = sp = _models.get(model_file) or _models.setdefault(model_file, sentencepiece.SentencePieceProcessor(model_file=model_file))
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ranked = sorted(ids, key=lambda i: (sp.is_byte(i), -sp.get_score(i)))
        zipf = prior / sum(1 / (k + 1) for k in range(len(ranked)))
        total = sum(uses.values()) + prior
        self.log_p = {(x := sp.id_to_piece(i)): math.log((uses.get(x, 0) + zipf / (k + 1)) / total) for k, i in enumerate(ranked)}
        self.byte = [self.log_p.get(f"<0x{b:02X}>", -30.0) for b in range(256)]
        for b in range(256):
            self.log_p.pop(f"<0x{b:02X}>", None)
        self.longest = max(map(len, self.log_p))

    def log10(self, word: str) -> float:
        text = "▁" + word
        get, longest, alpha = self.log_p.get, self.longest, [0.0]
        for end in range(1, len(text) + 1):
            terms = [alpha[start] + p for start in range(max(0, end - longest), end) if (p := get(text[start:end])) is not None]
            if text[end - 1] not in self.log_p:  # a character outside the vocabulary goes by its bytes
                terms.append(alpha[end - 1] + sum(self.byte[b] for b in text[end - 1].encode(errors="replace")))
            top = max(terms)
            alpha.append(top + math.log(sum([math.exp(t - top) for t in terms])) if len(terms) > 1 else top)
        return alpha[-1] / math.log(10)


def piece_uses(words: DataFrame, model_file: str) -> DataFrame:
    """How often the vocabulary's encoding uses each piece, each distinct word counting once: at most a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _models.get(model_file) or _models.setdefault(model_file, sentencepiece.SentencePieceProcessor(model_file=model_file))
        uses: Counter = Counter()
        for batch in batches:
            for pieces in sp.encode([w.decode(errors="replace") for w in batch.column(0).to_pylist()], out_type=str, num_threads=1):
                uses.update(pieces)
        yield pa.RecordBatch.from_arrays([pa.array(list(uses), pa.string()), pa.array(list(uses.values()), pa.int64())], ["piece", "n"])

    return words.select("word").mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with how often training and other texts hold them; words of held-out texts come with a count of 0."""
    known: Counter = Counter()
    others: set = set()

    def out():
        rest = others.difference(known)
        words = [*known, *rest]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*known.values(), *[0] * len(rest)], pa.int64())], ["word", "c"])

    for batch in batches:
        for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = text.encode().lower().split()
            if held:
                others.update(words)
            else:
                known.update(words)
                known[END] += 1
            if len(known) + len(others) > 300_000:
                yield out()
                known.clear()
                others.clear()
    yield out()


def score_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", folds: int = HELD_OUT_FOLDS, head: int = 65_536) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    The model learns from rows whose id's crc32 modulo folds is not 0. A null text is empty: its end is its only token. Repeated rows
    count as often as they stand. Without training rows every word is unseen. Texts are scored whole, whatever their length; words of
    equal counts count alike. Other columns are not read. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("held", fold_of(F.col("id"), folds) == 0)
    counts = rows.select("text", "held").mapInArrow(_count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    counts = materialize(counts, "words")
    n, v, ends = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0))
    ).first()
    stop = (ends + 1) / (n + 2)
    floor = math.log10(n + 0.1 * (v + 1))

    uses = {r.piece: r.n for r in piece_uses(counts.filter(F.col("c") > 0).filter(F.col("word") != END), model_file).collect()}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Lattice(model_file, uses)
        for batch in batches:
            words, cs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            score = [math.log10(stop) if w == END else math.log10(1 - stop) + pieces.log10(w.decode(errors="replace")) for w in words]
            base = [math.log10(c + 0.1) - floor for c in cs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(c > 0) for c in cs], pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], ["word", "known", "base", "score"])

    kinds = "word binary, known bigint, base double, score double"
    frequent = head_of(counts.filter((F.length("word") <= 64) & (F.col("word") != END) & (F.col("c") > 0)), "c", head)
    table = {bytes(r.word): (r.known, r.base, r.score) for r in frequent.unionByName(counts.filter(F.col("word") == END)).coalesce(6).mapInArrow(scored, kinds).collect()}
    table.setdefault(END, (0, math.log10(0.1) - floor, math.log10(stop)))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with the sums over words of the head, and a row for each other word that it holds."""
        known = sent.value
        names = ["id", "mark", "held", "rows", "tokens", "n_known", "base", "score", "word", "times"]
        types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.binary(), pa.int64()]
        for batch in batches:
            ids, marks, helds = batch.column(0), batch.column(1), batch.column(2)
            take, rest = [], ([], [], [], [], [], [], [])
            for k, text in enumerate(batch.column(3).to_pylist()):
                words = Counter(text.encode().lower().split())
                words[END] = 1
                n_known = base = score = 0
                take.append(k)
                at = len(take) - 1
                for r, x in zip(rest, (1, sum(words.values()), 0, 0.0, 0.0, None, 0), strict=True):
                    r.append(x)
                for word, times in words.items():
                    if (x := known.get(word)) is not None:
                        n_known += times * x[0]
                        base += times * x[1]
                        score += times * x[2]
                    else:
                        take.append(k)
                        for r, x in zip(rest, (0, 0, 0, 0.0, 0.0, word, times), strict=True):
                            r.append(x)
                rest[2][at], rest[3][at], rest[4][at] = n_known, base, score
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(index), marks.take(index), helds.take(index), *[pa.array(r, t) for r, t in zip(rest, types, strict=True)]], names)

    kinds_of = f"id {id_type}, mark bigint, held boolean, rows bigint, tokens bigint, n_known bigint, base double, score double, word binary, times bigint"
    # rows with one id are told apart by their texts, so that no row number is needed
    marked = rows.select("id", F.xxhash64("text").alias("mark"), "held", "text")
    parts = marked.mapInArrow(per_document, kinds_of)
    seen = parts.filter("word is not null").select("id", "mark", "held", "word", "times")
    words = counts.filter(F.col("word") != END).mapInArrow(scored, kinds)
    spread = Spread(counts.filter(F.length("word") > 64), "word", "c")
    seen = spread.join(seen, words, "word", by="mark").select(
        "id", "mark", "held", F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("tokens"),
        (F.col("times") * F.col("known")).alias("n_known"), (F.col("times") * F.col("base")).alias("base"), (F.col("times") * F.col("score")).alias("score"),
    )
    whole = parts.filter("word is null").drop("word", "times").unionByName(seen)
    whole = whole.groupBy("id", "mark", "held").agg(*[F.sum(c).alias(c) for c in ("rows", "tokens", "n_known", "base", "score")])
    each = lambda c: (F.col(c) / F.col("rows")).cast(whole.schema[c].dataType)
    return whole.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), each("tokens").alias("n_tokens"), each("n_known").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), each("base").alias("base_score"), each("score").alias("score"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("copy"),
    ).drop("copy")
