"""SentencePiece encoding and decoding for merge-type models, by a prefix table.

The merges of a text's prefix end in one token that no other choice can replace. So the table keeps a single token for each prefix: of
the vocabulary's tokens that end there (an automaton finds them), the one whose neighbour to the left, the last token of the prefix
before it, can stand beside it, that is, merging the two tokens' text gives the same two tokens. The ids are read off backwards.
Pieces never run past a word start (a white-space mark after another character), nor between two characters that stand together in no
piece, so a text is cut there first; frequent cuts are kept in bounded caches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache

MARK = "▁"
START = 1 << 19
#: Marks behind a word; known words are found more often without them.
TAIL = ".,;:!?#*$%&|<>\"')]}"


class Pairs(dict):
    """May two tokens (left << 20 | right) stand side by side? Answers are kept, up to ``size``."""

    def __init__(self, fits, size: int = 500_000):
        self.fits, self.size = fits, size

    def __missing__(self, pair: int) -> bool:
        if len(self) >= self.size:
            self.clear()
        answer = self[pair] = self.fits(pair >> 20, pair & 0xFFFFF)
        return answer


class PrefixTable:
    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.pieces: list[str] = []
        self.bytes: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.pieces.append("" if sp.is_control(i) or sp.is_unknown(i) else piece)
            if sp.is_byte(i):
                self.bytes[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.rank[piece] = i, -sp.get_score(i)
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        if any(MARK in x.lstrip(MARK) or "\n" in x for x in self.ids):
            raise ValueError("a piece runs past a word start or a line end: not a model that this table can cut")
        self.known = {x for x in self.ids if len(x) == 1}
        self.found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.found.add_word(piece, i)
        self.found.make_automaton()
        self.lengths = [len(x) for x in self.pieces]
        self.texts = [b"%d," % i for i in range(len(self.pieces))]
        self.pairs = Pairs(self.fits)
        #: what the last merge of a piece put together
        self.halves: dict[str, tuple[str, str]] = {}
        #: pairs of characters that stand together in some piece
        self.together = {x[k : k + 2] for x in self.ids for k in range(len(x) - 1)}

    def merge(self, text: str, until: int = 1) -> list[str]:
        """The merges themselves, over a short text: the best pair first, the leftmost of equals, while more than ``until`` parts stand."""
        parts = list(text)
        while len(parts) > until:
            best, at = min((self.rank.get(a + b, float("inf")), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str]:
        halves = self.halves.get(piece)
        if halves is None:
            left, right = self.merge(piece, 2)
            halves = self.halves[piece] = left, right
        return halves

    def fits(self, left: int, right: int) -> bool:
        """May these two tokens stand side by side? left is START where right begins the text. The merges that made them are undone, the
        latest first: what then stands on both sides of their border must not be a pair that merges before the merge just undone."""
        if left == START:
            return len(self.merge(self.pieces[right])) == 1
        x, y, rank = self.pieces[left], self.pieces[right], self.rank
        limit = float("inf")
        while True:
            r = rank.get(x + y)
            if r is not None and r < limit:
                return False
            made_x, made_y = (rank[z] if len(z) > 1 else -1.0 for z in (x, y))
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                limit, x = made_x, self._halves(x)[1]
            else:  # of equal pairs the leftmost merges first
                limit, y = made_y + 0.5, self._halves(y)[0]

    def _known_run(self, run: str) -> list[int]:
        last, lengths, pairs = [-1] * len(run) + [START], self.lengths, self.pairs
        # place -1 stands for the start
        for end, token in self.found.iter(run):
            if last[end] < 0:
                left = last[end - lengths[token]]
                if left >= 0 and pairs[left << 20 | token]:
                    last[end] = token
        out, at = [], len(run) - 1
        while at >= 0:
            token = last[at]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """A run of characters that stand together in pieces, or a character outside the vocabulary, which goes by its bytes."""
        return self._known_run(chunk) if chunk[0] in self.known else [self.byte_ids[b] for b in chunk.encode()]

    def decode_ids(self, ids: list[int]) -> bytes:
        """The bytes of the pieces, white-space marks as spaces, the first word's own mark included."""
        return b"".join(bytes([self.bytes[i]]) if i in self.bytes else self.pieces[i].replace(MARK, " ").encode() for i in ids)

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in Coder(self).chunks(text) for i in x.split(b",")[:-1]]

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(ids).decode(errors="replace").removeprefix(" ")


class Coder:
    """A table with caches: ids of words as decimal text, each with a comma behind it, and back."""

    def __init__(self, table: PrefixTable):
        self.table = table
        self.bare = WordCache(self._bare)
        self.marked = WordCache(lambda x: self._bare(MARK + x))
        self.back = WordCache(lambda x: table.decode_ids([int(i) for i in x.split(b",")[:-1]]))
        self.run = WordCache(self._encoded)
        self.line_end = self._bare("\n")

    def _encoded(self, run: str) -> bytes:
        return b"".join(map(self.table.texts.__getitem__, self.table.encode_chunk(run)))

    def _bare(self, chunk: str) -> bytes:
        together = self.table.together
        if len(chunk) <= self.run.longest and self.table.known.issuperset(chunk):  # a word, and marks behind it
            k = len(chunk.rstrip(TAIL))
            if k in (0, len(chunk)) or chunk[k - 1 : k + 1] in together:
                return self.run[chunk]
            return self.run[chunk[:k]] + self.run[chunk[k:]]
        start, out = 0, []
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in together:
                out.append(self.run[chunk[start:k]])
                start = k
        out.append(self.run[chunk[start:]])
        return b"".join(out)

    def chunks(self, text: str) -> list[bytes]:
        out: list[bytes] = []
        if not text:
            return out
        for k, line in enumerate((" " + text).split("\n")):
            if k:
                out.append(self.line_end)
            if "  " in line or MARK in line or line.endswith(" "):
                out += [self.bare[x] for x in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line.replace(" ", MARK))]
                continue
            first, *rest = line.split(" ")
            if first:
                out.append(self.bare[first])
            out += map(self.marked.__getitem__, rest)
        return out


_tables: dict[str, Coder] = {}


def coder(model_file: str) -> Coder:
    """One for each Python worker."""
    if model_file not in _tables:
        _tables[model_file] = Coder(PrefixTable(model_file))
    return _tables[model_file]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs, in place (no shuffle): id_col, n_tokens, ids_sha256, decoded_sha256, and ids where asked for.

    A null text counts as empty; an empty text has no ids. Repeated rows each give a row. Only the two named columns are read.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_file)
        for batch in batches:
            n, ids, digests, decoded = [], [], [], []
            for text in batch.column(1).to_pylist():
                parts = c.chunks(text or "")
                joined = b"".join(parts)[:-1]
                n.append(joined.count(b",") + 1 if joined else 0)
                digests.append(hashlib.sha256(joined).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(c.back.__getitem__, parts)).removeprefix(b" ")).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in joined.split(b",")] if joined else [])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("doc_id", id_col)
