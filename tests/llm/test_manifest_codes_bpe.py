"""The manifest tree, vector codes and byte-level BPE against plain versions of what they compute."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from rosterflow.llm import bpe, merkle, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([digest("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    return out


def plain_manifest(rows):
    def leaf(r, add=0):
        n = None if r[4] is None else r[4] + add
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])))

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    low = {x: levels_of([leaf(r) for r in trees[x]]) for x in langs}
    high = levels_of([low[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(trees[x]):
            siblings, node = [], leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                node = leaf(r, 1)
            for tree, at in ((low[x], i), (high, k)):
                for level in tree[:-1]:
                    other = level[at ^ 1 : (at ^ 1) + 1]
                    siblings += other
                    node = digest("".join([*other, node] if at % 2 else [node, *other]))
                    at //= 2
            out.append((r[0], leaf(r), low[x][-1][0], high[-1][0], digest("".join(siblings)), node, node == high[-1][0]))
    return out


def manifest_rows(n, langs, seed=0):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        rows.append((rnd.choice([k, k, k, k // 3, None]), rnd.choice([None, "", "a b", "éß" * rnd.randint(0, 5), "x" * rnd.randint(0, 3000)]), rnd.choice(langs), rnd.choice([None, "s", ""]), rnd.choice([None, 0, k])))
    return rows + rows[:7]


@pytest.mark.parametrize(("n", "langs", "block"), [(1, ["en"], 4096), (2, [None], 2), (90, ["en", "en", "en", None, "", "é", "-", ":"], 4), (130, [f"l{k}" for k in range(33)], 2), (260, ["en"], 8)])
def test_manifest_equals_the_plain_tree(spark, n, langs, block):
    rows = manifest_rows(n, langs, n)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"id": F.lit(1), "tree": F.lit("x"), "digest": F.lit("y"), "place": F.lit(2), "n": F.lit(3)})
    got = [tuple(r) for r in merkle.digest_report(merkle.verify_manifest(docs, block=block)).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    assert {r[6] for r in got if r[1] == r[1]} <= {True, False}


def test_manifest_of_nothing_and_bad_blocks(spark):
    docs = spark.createDataFrame([], DOCS)
    report = merkle.digest_report(merkle.verify_manifest(docs))
    assert report.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and report.isEmpty()
    with pytest.raises(ValueError):
        merkle.proofs(docs.select(F.lit("a").alias("t"), F.lit(0).alias("place"), F.lit(1).alias("n"), F.lit(b"").alias("digest")), "t", block=12)


def test_a_walk_and_its_folds_agree():
    for n in range(1, 70):
        nodes = [hashlib.sha256(b"%d" % k).digest() for k in range(n)]
        top, proofs = merkle.climb(nodes, (n - 1).bit_length())
        assert top.hex() == levels_of([x.hex() for x in nodes])[-1][0]
        assert all(merkle.fold(x, p, (k, n)) == top for k, (x, p) in enumerate(zip(nodes, proofs, strict=True)))
        assert merkle.fold(b"\0" * 32, proofs[0], (0, n)) != top


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(c) for c in zip(*xs, strict=True)]
    out, sums = [], {}
    for i, v, y in kept:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        sums[y] = sums.get(y, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, y))
    text = ",".join(str(c) for book in books for e in book for c in e)
    return [(i, code, error, sums[y], digest(text)) for i, code, error, y in out]


@pytest.mark.parametrize(("n", "spread"), [(400, 0.4), (300, 0.02), (30, 1.0), (1, 1.0), (150, 1000.0)])
def test_vector_codes_equal_plain_rounds(spark, n, spread):
    """Few distinct values make many ties; few rows make small codebooks."""
    rnd = random.Random(n)
    rows = [(k, [float(np.float32(rnd.choice([rnd.gauss(0, spread), -spread, 0.0]))) for _ in range(32)], rnd.choice([None, 1, 1, 1, 2])) for k in range(n)]
    rows = rows + rows[: n // 4]
    rnd.shuffle(rows)
    bad = [(-1, None, 1), (-2, [None] + [0.0] * 31, 1), (-3, [float("nan")] + [0.0] * 31, 1), (-4, [float("-inf")] * 32, None)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumns({"x": F.lit(1), "id": F.lit(2), "own": F.lit(3), "_key": F.lit("k")}).repartition(3)
    got = [tuple(r) for r in vector_codes.code_report(table).collect()]
    assert sorted(got) == sorted(plain_codes(rows))


def test_vector_codes_with_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert vector_codes.code_report(spark.createDataFrame([], schema)).isEmpty()
    assert vector_codes.code_report(spark.createDataFrame([(1, None, "a")], schema)).isEmpty()
    rows = [Row(vec_id=None, embedding=[0.5] * 16, label="a"), Row(vec_id=3, embedding=[1.0] * 16, label=None), Row(vec_id=2, embedding=[1.0] * 5, label="a"), Row(vec_id=4, embedding=[], label="b")]
    rows += [Row(vec_id=9, embedding=[-0.25] * 16, label="a")]
    got = {r.vec_id: r for r in vector_codes.code_report(spark.createDataFrame(rows, schema)).collect()}
    assert got[2].code is None and got[4].code is None and got[4].label_error is None and got[3].code == "00" * 16 and got[None].code == "02" * 16 and got[9].error == 0
    with pytest.raises(ValueError):
        vector_codes.code_report(spark.createDataFrame([(1, [1.0] * 17, "a")], schema))


def test_bounds_are_never_above_distances():
    rnd = np.random.default_rng(5)
    x = rnd.integers(-300, 300, (500, 4))
    entries = rnd.integers(-300, 300, (1, 40, 4))
    groups = np.stack([vector_codes.groups_of(entries[0], 4)])
    books, own, bounds = vector_codes.Books(entries, groups, 4), np.zeros(500, np.int64), np.zeros((500, 4))
    for _ in range(6):
        own, least, bounds = books.assign(x, 0, own, bounds)
        bounds = vector_codes.halves_down(bounds).astype(np.float64)
        full = ((x[:, None] - books.entries[0]) ** 2).sum(axis=2)
        assert (own == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
        full = np.sqrt(full)
        full[np.arange(500), own] = np.inf
        for g in range(4):
            assert (bounds[:, g] <= full[:, groups[0] == g].min(axis=1)).all()
        books = books.next(books.entries + rnd.integers(-20, 20, entries.shape))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def coder():
    return bpe.byte_coder(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library_on_odd_texts(coder, library):
    rnd = random.Random(3)
    signs = [*"aabbcdee  \n\t'sStTrevmld.,!?0123éèüßñ漢字カタ😀👍  ​　\x85\x1c\x0b\r", "<|endoftext|>", "<|endoftext", "  ", "the", "ing", " of", "'ll", "'RE", "́"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(8000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(4000)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert coder.encode(text) == want.ids, ascii(text)
        assert coder.table.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_bpe_takes_time_in_proportion_on_long_words(coder, library):
    rnd = random.Random(4)
    for text in ("a" * 100_000, "ab" * 50_000, " " * 100_000, "\n" * 50_000, "漢" * 30_000, "1" * 100_000, "".join(rnd.choice("abc") for _ in range(100_000)), "x!" * 50_000):
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_decodes_any_ids_as_the_library_does(coder, library):
    rnd = random.Random(6)
    for _ in range(500):
        ids = [rnd.randrange(50_257) for _ in range(15)]
        assert coder.table.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_over_rows(spark, library):
    rows = [(1, None, 0), (None, "", 0), (2, "Hello <|endoftext|>world", 0), (2, "Hello <|endoftext|>world", 0), (3, "long " * 20_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    got = sorted(bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect(), key=str)
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append(Row(doc_id=i, n_tokens=len(ids), ids_sha256=hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), decoded_sha256=digest(text or ""), ids=ids))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).isEmpty()
