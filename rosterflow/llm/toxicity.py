"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are by document. Tokens get theirs from them: in the toxic texts of a bounded sample, a token is toxic if its word or its stem
(the first five letters) stands in many different places of toxic texts and hardly any of others; a place is the pair of neighbouring
words, so that copies of one text count once. The field has two states, weights for hashed features of the token (word, stems) and for transitions, and is trained on those token labels by gradient. Forward-backward gives
each token's marginal; a logistic over the largest marginal and the expected number of toxic tokens, fitted on the sample, gives the
document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, fold_of

BITS = 18
STEMS = (4, 5, 6)
STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_"
HELD_OUT_FOLDS = 5
_MOST = 1e12


def normal(token: bytes) -> bytes:
    return token.strip(STRIP)


def features(token: bytes) -> list[int]:
    """Places in the weight table: bias, word, stems."""
    word = normal(token).decode(errors="replace")
    keys = ["bias", f"w={word}", *[f"{n}={word[:n]}" for n in STEMS if len(word) >= n]]
    return [zlib.crc32(k.encode()) & ((1 << BITS) - 1) for k in keys]


@dataclass
class Field:
    weights: np.ndarray
    transitions: np.ndarray  # [from, to]
    final: np.ndarray  # logistic: intercept, largest marginal's logit, log of the expected count

    def emission(self, token: bytes) -> float:
        return float(np.exp(np.clip(self.weights[features(token)].sum(), -25, 25)))

    def marginals(self, g: np.ndarray) -> np.ndarray:
        """g: odds of the toxic state by token, a row for each text, padded at the end by 1. As odds, the recursions are
        fractions of first-degree terms."""
        (a, b), (c, d) = np.exp(self.transitions)
        n = g.shape[1]
        forward, behind = np.empty_like(g), np.empty_like(g)
        r = g[:, 0].copy()
        forward[:, 0] = r
        for t in range(1, n):
            r = np.minimum(g[:, t] * (b + d * r) / (a + c * r), _MOST)
            forward[:, t] = r
        s = np.ones(len(g))
        behind[:, n - 1] = s
        for t in range(n - 2, -1, -1):
            x = np.minimum(g[:, t + 1] * s, _MOST)
            s = (c + d * x) / (a + b * x)
            behind[:, t] = s
        odds = forward * behind
        return odds / (1 + odds)

    def score(self, largest: np.ndarray, expected: np.ndarray) -> np.ndarray:
        p = np.clip(largest, 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-np.clip(self.final[0] + self.final[1] * np.log(p / (1 - p)) + self.final[2] * np.log1p(expected), -35, 35)))


def token_labels(texts: list[list[bytes]], toxic: list[int], least: int = 4, purity: float = 0.97) -> list[np.ndarray]:
    places: dict[bytes, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    for words, label in zip(texts, toxic, strict=True):
        plain = [normal(w) for w in words]
        for k, w in enumerate(plain):
            if len(w) >= 3:
                place = zlib.crc32((plain[k - 1] if k else b"") + b" " + (plain[k + 1] if k + 1 < len(plain) else b""))
                places[w][label].add(place)
                if len(w) >= 6:
                    places[b"^" + w[:5]][label].add(place)
    odds = max(1, sum(toxic)) / max(1, len(toxic) - sum(toxic))
    sure = {w for w, (clean, bad) in places.items() if len(bad) >= least * (2 if w[:1] == b"^" else 1) and len(bad) >= purity * (len(bad) + len(clean) * odds)}
    return [np.array([label and ((p := normal(w)) in sure or (len(p) >= 6 and b"^" + p[:5] in sure)) for w in words], np.int8) for words, label in zip(texts, toxic, strict=True)]


def train(texts: list[str], toxic: list[int], prevalence: float, seed: int = 5, span: int = 32, epochs: int = 6, batch: int = 256) -> Field:
    """Fits the field on a sample of texts; prevalence: the share of toxic texts among all labelled ones."""
    words = [t.encode().lower().split() for t in texts]
    labels = token_labels(words, toxic)
    rng = np.random.default_rng(seed)
    hot, cold = [], []
    for k, y in enumerate(labels):
        for start in range(0, len(y), span):
            (hot if y[start : start + span].any() else cold).append((k, start))
    if hot and cold:
        cold = [cold[i] for i in rng.permutation(len(cold))[: 3 * len(hot)]]
    width = 2 + len(STEMS)
    cache = WordCache(features)
    chunks = hot + cold if hot else []
    x = np.full((len(chunks), span, width), 1 << BITS, np.int64)  # the last weight stays 0
    y = np.zeros((len(chunks), span), np.int8)
    size = np.zeros(len(chunks), np.int64)
    for n, (k, start) in enumerate(chunks):
        part = words[k][start : start + span]
        size[n] = len(part)
        y[n, : len(part)] = labels[k][start : start + span]
        for t, w in enumerate(part):
            f = cache[w]
            x[n, t, : len(f)] = f
    field = Field(np.zeros((1 << BITS) + 1), np.zeros((2, 2)), np.array([0.0, 1.0, 0.0]))
    squares, t_squares = np.full(len(field.weights), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(epochs if chunks else 0):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), batch):
            i = order[at : at + batch]
            live = np.arange(span)[None, :] < size[i, None]
            g = np.where(live, np.exp(np.clip(field.weights[x[i]].sum(2), -25, 25)), 1.0)
            (a, b), (c, d) = np.exp(field.transitions)
            p = field.marginals(g)
            # pair marginals from the same odds: p(t=1, t+1=1) and so on
            ahead = (c + d * g[:, 1:]) / (a + b * g[:, 1:])
            p_next = p[:, 1:]
            r = p[:, :-1] / np.maximum(1 - p[:, :-1], 1e-12) / np.maximum(ahead, 1e-12)
            to1 = r * d / (b + r * d)  # of the ways into state 1, those from state 1
            to0 = r * c / (a + r * c)
            pair = np.stack([np.stack([(1 - p_next) * (1 - to0), p_next * (1 - to1)]), np.stack([(1 - p_next) * to0, p_next * to1])])
            both = live[:, 1:]
            seen = np.array([[((y[i][:, :-1] == u) & (y[i][:, 1:] == v) & both).sum() for v in (0, 1)] for u in (0, 1)], float)
            t_grad = (seen - (pair * both).sum((2, 3))) / len(i)
            err = np.where(live, y[i] - p, 0.0)
            grad = np.zeros(len(field.weights))
            np.add.at(grad, x[i].ravel(), np.repeat(err.ravel(), width))
            grad = grad / len(i) - 1e-6 * field.weights
            squares += grad**2
            t_squares += t_grad**2
            field.weights += 0.3 * grad / np.sqrt(squares)
            field.transitions = np.clip(field.transitions + 0.1 * t_grad / np.sqrt(t_squares), -8, 8)
            field.weights[1 << BITS] = 0
    # the logistic over whole texts, each class weighted to its share
    largest, expected = summaries(field, words, WordCache(field.emission))
    p = np.clip(largest, 1e-9, 1 - 1e-9)
    z = np.stack([np.ones(len(p)), np.log(p / (1 - p)), np.log1p(expected)], 1) if len(p) else np.zeros((0, 3))
    t = np.array(toxic, float)
    weight = np.where(t == 1, prevalence / max(t.mean(), 1e-9), (1 - prevalence) / max(1 - t.mean(), 1e-9)) if len(t) else t
    beta = np.array([np.log(max(prevalence, 1e-6) / max(1 - prevalence, 1e-6)), 0.0, 0.0])
    for _ in range(100 if 0 < t.sum() < len(t) else 0):
        q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (weight * q * (1 - q))[:, None]).T @ z + np.diag([1e-6, 1e-3, 1e-3]) * len(t)
        step = np.linalg.solve(hessian, z.T @ (weight * (t - q)) - np.array([1e-6, 1e-3, 1e-3]) * len(t) * beta)
        beta += step / max(1.0, float(np.abs(step).max()))  # short steps: whole ones run away where the classes lie apart
    field.final = beta
    return field


def marginals_of(field: Field, texts: list[list[bytes]], emissions: WordCache, cells: int = 400_000) -> Iterator[tuple[int, np.ndarray]]:
    """(place, marginals) of every text that has tokens; texts of like length go together, at most about ``cells`` tokens at once."""
    order = sorted((k for k, w in enumerate(texts) if w), key=lambda k: len(texts[k]))
    at = 0
    while at < len(order):
        end, least = at, len(texts[order[at]])
        while end < len(order) and (len(texts[order[end]]) <= 2 * least or end - at < 4) and (end + 1 - at) * len(texts[order[end]]) <= max(cells, len(texts[order[at]])):
            end += 1
        end = max(end, at + 1)
        part = order[at:end]
        g = np.ones((len(part), len(texts[part[-1]])))
        for n, k in enumerate(part):
            g[n, : len(texts[k])] = np.fromiter(map(emissions.__getitem__, texts[k]), float, len(texts[k]))
        p = padded(field, g, [len(texts[k]) for k in part])
        for n, k in enumerate(part):
            yield k, p[n, : len(texts[k])]
        at = end


def padded(field: Field, g: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Marginals of rows of unequal length: the backward recursion of each starts at its own end."""
    (a, b), (c, d) = np.exp(field.transitions)
    rows, n = g.shape
    size = np.array(sizes)
    columns = np.ascontiguousarray(g.T)
    forward = np.empty_like(columns)
    r = columns[0].copy()
    forward[0] = r
    for t in range(1, n):
        r = np.minimum(columns[t] * (b + d * r) / (a + c * r), _MOST)
        forward[t] = r
    s = np.ones(rows)
    out = np.empty_like(columns)
    for t in range(n - 1, -1, -1):
        if t < n - 1:
            x = np.minimum(columns[t + 1] * s, _MOST)
            s = np.where(t + 1 < size, (c + d * x) / (a + b * x), 1.0)
        odds = forward[t] * s
        out[t] = odds / (1 + odds)
    return out.T


def summaries(field: Field, texts: list[list[bytes]], emissions: WordCache) -> tuple[np.ndarray, np.ndarray]:
    largest, expected = np.zeros(len(texts)), np.zeros(len(texts))
    for k, p in marginals_of(field, texts, emissions):
        largest[k], expected[k] = p.max(), p.sum()
    return largest, expected


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, per_class: int) -> tuple[list[str], list[int], float]:
    """At most ``per_class`` labelled texts of each class by the hash of their ids, of any length; and the share of toxic ones among all
    labelled rows outside the held-out fold. Of several rows of one id the least text counts; null texts are empty."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").filter(fold_of(F.col("id"), folds) != 0)
    share = known.agg(F.avg("label")).first()[0] or 0.0
    picked = [known.filter(F.col("label") == k).select("id", "label").orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]).groupBy("id").agg(F.max("label").alias("label")))  # at most 2 * per_class rows
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(ids, "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))  # a row an id: at most 2 * per_class
    rows = sorted((r.id, r.text, r.label) for r in rows.collect())
    return [r[1] for r in rows], [r[2] for r in rows], share


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = HELD_OUT_FOLDS, per_class: int = 2000, with_spans: bool = False) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted; with_spans adds the offending offsets (code points, end exclusive).

    Only labels of rows outside the held-out fold are read, at most ``per_class`` of each class. Without labels of both classes every
    score is the share of toxic rows. A null or empty text has no tokens and scores as one without toxic tokens. Texts go in whole,
    whatever their length. Repeated rows each give a row, with one score. Other columns are not read.
    """
    field = train(*training_sample(docs, labels, id_col, text_col, label_col, folds, per_class))
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        emissions = WordCache(model.emission)
        for batch in batches:
            text = batch.column(2).to_pylist()
            largest, expected = np.zeros(len(text)), np.zeros(len(text))
            spans: list[list[dict]] = [[] for _ in text]
            at = 0
            while at < len(text):
                end, size = at, 0
                while end < len(text) and (size < 4_000_000 or end == at):
                    size += len(text[end])
                    end += 1
                words = [t.encode().lower().split() for t in text[at:end]]
                for k, p in marginals_of(model, words, emissions):
                    largest[at + k], expected[at + k] = p.max(), p.sum()
                    if with_spans and p.max() >= 0.5:
                        for m, hit in zip(re.finditer(r"[^\x20\x09-\x0D]+", text[at + k]), p >= 0.5, strict=True):
                            if hit and spans[at + k] and text[at + k][spans[at + k][-1]["end"] : m.start()].strip() == "":
                                spans[at + k][-1]["end"] = m.end()
                            elif hit:
                                spans[at + k].append({"start": m.start(), "end": m.end()})
                at = end
            score = model.score(largest, expected)
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            names = ["id", "held_out", "score", "predicted"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, held_out boolean, score double, predicted int" + ", spans array<struct<start:int,end:int>>" * with_spans
    rows = docs.select(F.col(id_col).alias("id"), (fold_of(F.col(id_col), folds) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
