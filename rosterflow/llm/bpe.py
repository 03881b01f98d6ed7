"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

Texts are cut into words as the vocabulary's own pattern cuts them. Within a word an automaton over the tokens finds the longest
token from a byte on. The encoder walks from left to right: it takes the longest token that is compatible with the one before it, that is, whose text together with that of its neighbour merges into just these two; else the next shorter one; and where none
is left, it marks the place as dead and steps back. Each place dies once, so the time is linear in the word, whatever its length.
Decoding gathers the tokens' bytes from one buffer by a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache
from .packing import BYTE_SIGNS
from .pieces import Pairs

#: Fixed value: the cutting pattern of this kind of vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A space before what is no white space begins a word always, so a text may be cut there, and its parts cached.
CUT = re.compile(r" (?=\S)")
#: A space after which it may not be cut.
ODD = re.compile(r" (?:\s|\Z)")
NEVER = float("inf")


class BackTable:
    """A vocabulary's tokens with what the encoder asks of them. Every single byte must be a token, and one merge alone make each longer one."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("normalizer") or model.get("ignore_merges") or not (spec.get("pre_tokenizer") or {}).get("use_regex", False):
            raise ValueError("not a byte-level vocabulary with the usual cutting pattern")
        signs = {chr(c): b for b, c in BYTE_SIGNS.items()}
        raw = {name: bytes(signs[c] if c in signs else ord(c) for c in name) for name in model["vocab"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.bytes = [b""] * size
        for name, i in model["vocab"].items():
            self.bytes[i] = raw[name]
        ids = {b: i for i, b in enumerate(self.bytes) if b}
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        if any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("a byte is no token")
        self.merges: dict[tuple[int, int], int] = {}
        #: what made a token, and when; single bytes were there before
        self.halves, self.made = [(-1, -1)] * size, [-1.0] * size
        for rank, pair in enumerate(model["merges"]):
            left, right = (ids[raw[x]] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = ids[self.bytes[left] + self.bytes[right]]
            if self.made[whole] >= 0:
                raise ValueError("a token is made by two merges")
            self.merges[left, right], self.halves[whole], self.made[whole] = rank, (left, right), rank
        self.lengths = [len(b) for b in self.bytes]
        #: the longest token that begins a token
        self.shorter = [-1] * size
        self.pairs = Pairs(self.fits)
        self.whole: dict[int, bool] = {}
        standing = {text: i for text, i in ids.items() if self.stands(i)}
        self.found = ahocorasick.Automaton()
        for text, i in standing.items():
            self.found.add_word(text.decode("latin-1"), i)
            self.shorter[i] = next((standing[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in standing), -1)
        self.found.make_automaton()
        self.most = max(map(len, standing))
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.text = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def fits(self, left: int, right: int) -> bool:
        """Do two tokens stay as they are side by side? Their last merges are undone, the latest first; what then stands on both sides of
        the border must not be a pair that merges earlier. Of equal pairs the left one merges first."""
        limit = NEVER
        while self.merges.get((left, right), NEVER) >= limit:
            made_left, made_right = self.made[left], self.made[right]
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                limit, left = made_left, self.halves[left][1]
            else:
                limit, right = made_right + 0.5, self.halves[right][0]
        return False

    def stands(self, token: int) -> bool:
        """Do a token's own bytes merge into it? One that does not never comes out."""
        known = self.whole.get(token)
        if known is None:
            left, right = self.halves[token]
            known = self.whole[token] = left < 0 or self.stands(left) and self.stands(right) and self.meets(left, right)
        return known

    def meets(self, left: int, right: int) -> bool:
        """Do two tokens come to stand side by side before they merge?"""
        limit = self.merges[left, right]
        while True:
            made_left, made_right = self.made[left], self.made[right]
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                limit, left = min(limit, made_left), self.halves[left][1]
            else:
                limit, right = min(limit, made_right + 0.5), self.halves[right][0]
            if self.merges.get((left, right), NEVER) < limit:
                return False

    def encode_word(self, word: str) -> list[int]:
        """The tokens of a word whose characters stand for bytes."""
        pairs, tokens = self.pairs, [t for _, t in self.found.iter_long(word)]
        for k in range(1, len(tokens)):
            if not pairs[tokens[k - 1] << 20 | tokens[k]]:
                return self._step_back(word, tokens, k)
        return tokens

    def _step_back(self, word: str, tokens: list[int], k: int) -> list[int]:
        """Goes on from the first token that does not fit."""
        n, lengths, shorter, pairs, found = len(word), self.lengths, self.shorter, self.pairs, self.found
        out, token = tokens[:k], tokens[k]
        at = sum(map(lengths.__getitem__, out))
        dead: set[int] = set()
        while True:
            end = at + lengths[token]
            if end not in dead and (not out or pairs[out[-1] << 20 | token]):
                out.append(token)
                if end == n:
                    return out
                at, token = end, next(found.iter_long(word[end : end + self.most]))[1]
                continue
            token = shorter[token]
            while token < 0:  # nothing goes on from here: what led here is cut shorter
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.ends[ids] - self.starts[ids]
        before = np.cumsum(lengths) - lengths
        return self.text[np.repeat(self.starts[ids] - before, lengths) + np.arange(int(lengths.sum()))].tobytes()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, np.int64)).decode(errors="replace")


def like(char: str) -> str:
    """A character of the class (letter, number or other) that the library's tables give char."""
    from tokenizers.pre_tokenizers import ByteLevel

    cutter = ByteLevel(add_prefix_space=False)
    return next((x for x in "a1!" if len(cutter.pre_tokenize_str(x + char)) == 1), "\x85")


class ByteCoder:
    """A table with bounded caches of the ids of words, with and without the space before them, as little-endian 32-bit numbers."""

    def __init__(self, table: BackTable):
        self.table = table
        self.bare = WordCache(self._ids)
        self.spaced = WordCache(lambda x: self._ids(" " + x))
        self.word = WordCache(lambda x: b"".join(map(table.packed.__getitem__, table.encode_word(x.encode().decode("latin-1")))))

        self.likes = WordCache(like)

    def words(self, part: str) -> list[str]:
        """Characters that only a newer Unicode version may know are cut as the library would."""
        if part.isascii() or not (new := {c for c in part if unicodedata.category(c) == "Cn"}):
            return WORDS.findall(part)
        stands = part.translate({ord(c): self.likes[c] for c in new})
        return [part[m.start() : m.end()] for m in WORDS.finditer(stands)]

    def _ids(self, part: str) -> bytes:
        return b"".join([self.word[x] for x in self.words(part)])

    def _plain(self, text: str) -> list[bytes]:
        if not text:
            return []
        first, *rest = text.split(" ") if ODD.search(text) is None else CUT.split(text)
        return [self.bare[first], *map(self.spaced.__getitem__, rest)]

    def packed(self, text: str) -> bytes:
        """The ids of a text, its special tokens' strings as these tokens."""
        cut = self.table.special_cut
        if cut is None or cut.search(text) is None:
            return b"".join(self._plain(text))
        out: list[bytes] = []
        for k, part in enumerate(cut.split(text)):
            out += [self.table.packed[self.table.special[part]]] if k % 2 else self._plain(part)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()


_coders: dict[str, ByteCoder] = {}


def byte_coder(tokenizer_file: str) -> ByteCoder:
    """One for each Python worker."""
    if tokenizer_file not in _coders:
        _coders[tokenizer_file] = ByteCoder(BackTable(tokenizer_file))
    return _coders[tokenizer_file]


def encode_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs, in place (no shuffle): id_col, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256,
    and ids where asked for.

    A null text counts as empty; an empty text has no ids. Repeated rows and rows without an id each give a row; an empty table gives none.
    Texts count whole, in time linear in their length. Only the two named columns are read, so others may have any names.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(tokenizer_file)
        for batch in batches:
            n, ids, digests, decoded = [], [], [], []
            for text in batch.column(1):
                packed = coder.packed(text.as_py() or "")
                numbers = np.frombuffer(packed, "<u4")
                n.append(len(numbers))
                digests.append(hashlib.sha256(packed).hexdigest())
                back = coder.table.decode_bytes(numbers.astype(np.int64))
                decoded.append(hashlib.sha256(back.decode(errors="replace").encode()).hexdigest())
                if with_ids:
                    ids.append(numbers.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("doc_id", id_col)
