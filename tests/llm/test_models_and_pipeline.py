"""Toxicity, HTML extraction, near duplicates and the pipeline against brute force, exact expectations or held-out accuracy."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterflow.llm import common, exact_dedup, html_extract, near_dup, toxicity, warc

SF = "/root/testdata/sf0.01"


def brute_marginals(g, transitions):
    """All state paths of one text."""
    total, hit = 0.0, np.zeros(len(g))
    for path in itertools.product((0, 1), repeat=len(g)):
        w = np.prod([g[t] if s else 1.0 for t, s in enumerate(path)]) * np.prod([np.exp(transitions[a][b]) for a, b in itertools.pairwise(path)])
        total += w
        hit += w * np.array(path)
    return hit / total


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros((1 << toxicity.BITS) + 1), rng.normal(size=(2, 2)), np.zeros(3))
    sizes = [7, 4, 1]
    g = np.exp(rng.normal(size=(3, 7)))
    for row, size in enumerate(sizes):
        assert np.allclose(toxicity.padded(field, g, sizes)[row, :size], brute_marginals(g[row, :size], field.transitions))
    assert np.allclose(field.marginals(g)[0], brute_marginals(g[0], field.transitions))


def test_toxicity_holds_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(10**9, None, "idiot"), (10**9 + 1, "", "moron")], "doc_id bigint, text string, score string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.unionByName(extra, allowMissingColumns=True), labels, with_spans=True).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert got[10**9].predicted == got[10**9 + 1].predicted == 0
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.93
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = collections.Counter(texts[i][s.start : s.end].lower().strip(".,") for i, r in got.items() if i in texts for s in r.spans)
    assert words["idiot"] + words["moron"] > 0
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.score_toxicity(docs, none).collect()] == [0, 0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, as all do.</p></div>
<article><h1>A  heading &amp; more</h1><p><b>First, with <i>marks</i>.<br>Second&nbsp;line &lt;b&gt;.<p>Third one, quite long enough to count.</p>
<ul><li>One item.<li>Two items.</ul><div class="ad">Buy this now, today!</div><form><p>Your mail:</p></form></article>
<aside><p>More to read, over here.</p></aside><div id="comments"><p>Nice, thanks!</p></div><footer><p>&copy; 2024, all.</p></footer>"""


def test_html_extraction(spark):
    expected = "A heading & more\nFirst, with marks.\nSecond line <b>.\nThird one, quite long enough to count.\nOne item.\nTwo items."
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<nav><a>x</a></nav>"), (5, "u", "<p>" + "long. " * 50_000), (5, "u", "<b <a href='"), (6, "u", "<div " * 2000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract_main_text(df).collect()), key=repr)
    texts = collections.defaultdict(set)
    for i, _, t, n in got:
        texts[i].add(t)
        assert n == len(t)
    assert texts[1] == {expected}
    assert texts[2] == texts[3] == texts[4] == {""}
    assert ("long. " * 50_000).strip() in texts[5]
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_homes_and_words_of_furniture_weigh_and_do_not_decide():
    body = "".join(f"<p>Paragraph {k} of the story, which goes on for a while, and says more than any teaser does.</p>" for k in range(12))
    told = [f"Paragraph {k} of the story, which goes on for a while, and says more than any teaser does." for k in range(12)]
    cards = "".join(f"<article class=card><a href=/{k}>Teaser {k}</a><p>Short teaser text.</p></article>" for k in range(4))
    for page in (
        f"<main><div>{body}</div></main><div>{cards}</div>",
        f"<div class='content'>{body}</div>{cards}",
        f"<div class='content-sidebar-wrap'>{body}</div>",
        f"<div class='has-sidebar'><div class='post share-enabled'>{body}</div></div>",
        f"<div class='has-sidebar'><p>Short line.</p><div class='share-enabled'>{body}</div></div>",
    ):
        assert [x for x in html_extract.extract(f"<html><body>{page}</body></html>").split("\n") if x.startswith("Paragraph")] == told, page
    comments = "".join(f"<div><p>Comment {k}, rather nice, thanks.</p></div>" for k in range(4))
    page = f"<html><body><div class='post'><div class='entry-header'><h1>The heading of the story, in full.</h1></div>{body}</div><div class='post-comments'>{comments}</div><div class='sidebar'><p>Other, things.</p></div></body></html>"
    assert html_extract.extract(page).split("\n") == ["The heading of the story, in full.", *told]
    # text beside an article that holds nearly all of it still goes
    assert html_extract.extract(f"<body><article>{body}</article><p>Beside it, a line.</p></body>").split("\n") == told


def test_supplied_pages_give_their_articles(spark):
    import html
    import re

    for r in html_extract.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article))
        assert r.text == "\n".join(x for x in parts if x)


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    sets = near_dup.Sets(np.ones(1 << near_dup.DF_BITS, np.float32), 600)
    keys = np.sort(rng.integers(0, 1 << 63, 500, np.uint64))
    weights = rng.uniform(1, 5, 500).astype(np.float32)
    for kept in (450, 400, 250):
        a, b = (keys[:kept], weights[:kept]), (keys[500 - kept :], weights[500 - kept :])
        s = sets.samples([a, b])
        assert abs((s[0] == s[1]).mean() - near_dup.similarity(a, b)) < 0.07


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_near_duplicates_find_planted_groups(spark):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(3000))
    rows, group = [], {}
    for g in range(40):
        base = [word() for _ in range(rng.choice([60, 200, 400]))]
        for copy in range(rng.choice([1, 1, 2, 6, 30])):
            text = list(base)
            for _ in range(copy and max(1, len(base) // 100)):
                text[rng.randrange(len(text))] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "two words"), (1004, "Two  WORDS"), (1005, "two worlds"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"node": F.lit(1), "class_id": F.lit("x")})
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.class_id for r in got}
    text = dict(rows)
    sets = {i: shingles(t or "") for i, t in text.items()}
    links = [(a, b) for a, b in itertools.combinations([i for i in text if i < 1000], 2) if group[a] == group[b] and len(sets[a] & sets[b]) >= 0.82 * len(sets[a] | sets[b])]
    assert sum(of[a] == of[b] for a, b in links) >= 0.99 * len(links) > 100
    assert all(group[i] == group[c] for i, c in of.items() if i < 1000)  # nothing unlike is joined
    assert of[1000] == of[1001] == of[1002] == 1000
    assert of[1003] == of[1004] == 1003
    assert of[1005] == 1005
    sizes = collections.Counter(of[i] for i, _ in rows)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)
    kept = near_dup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(of.values()))
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_stages_take_effect(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.materialize(stage(spark, before, SF), name.replace(" ", "-"))
        assert after.columns == columns
        assert ids(after) <= ids(before)
        if name == "exact dedup":
            lowered = lambda df: {r.text.encode().lower() for r in df.collect()}
            assert lowered(after) == lowered(before)
            assert after.count() == len(lowered(before))
        if name == "secret scans":
            assert ids(after) == ids(before)
            assert not any("AKIA" in r.text and "[secret]" not in r.text for r in after.filter(F.col("text").rlike("AKIA[A-Z0-9]{14,}")).collect())
        before = after
    last = pipeline.STAGES[-1][1](spark, before, SF)
    assert ids(last) == ids(before)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    first = ids(pipeline.STAGES[0][1](spark, docs, SF))
    long_enough = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 20}
    assert len(first & good & long_enough) >= 0.98 * len(good & long_enough)


@pytest.mark.parametrize("page", ["<div>x" * 17_000, "<a '" * 25_000, '<a "' * 25_000, "<ul>" + "<li><a href=/a>Menu entry</a></li>" * 3_000 + "</ul>", "</p>" * 25_000, "<" * 100_000, "<!--" * 25_000, "<b>x" * 25_000])
def test_odd_pages_take_no_longer_than_their_length_allows(page):
    import time

    began = time.perf_counter()
    html_extract.extract(page)
    assert time.perf_counter() - began < 5


def test_a_page_of_links_alone_has_no_text():
    assert html_extract.extract("<div><ul>" + "".join(f"<li><a href=/{k}>Menu entry {k}, here.</a></li>" for k in range(9)) + "</ul></div>") == ""


def test_toxic_scores_are_those_of_the_field(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.limit(60)
    field = toxicity.train(*toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 5, 2000))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    for r in docs.collect():
        words = (r.text or "").encode().lower().split()
        g = [field.emission(w) for w in words]
        (a, b), (c, d) = np.exp(field.transitions)
        # forward and backward over both states, each step scaled
        f, back = np.ones((len(g), 2)), np.ones((len(g), 2))
        for k, x in enumerate(g):
            prior = f[k - 1] @ np.array([[a, b], [c, d]]) if k else np.ones(2)
            f[k] = prior * np.array([1.0, x])
            f[k] /= f[k].sum()
        for k in range(len(g) - 2, -1, -1):
            back[k] = np.array([[a, b], [c, d]]) @ (back[k + 1] * np.array([1.0, g[k + 1]]))
            back[k] /= back[k].sum()
        p = f * back
        p = p[:, 1] / p.sum(1) if len(g) else np.zeros(1)
        expected = field.score(np.array([p.max()]), np.array([p.sum() if len(g) else 0.0]))[0]
        assert abs(got[r.doc_id] - expected) < 1e-6


def test_training_keeps_long_and_repeated_rows(spark):
    bad = "you utter scum " * 5_000
    docs = spark.createDataFrame([(k, bad if k % 2 else "a fine day in the park") for k in range(40)] + [(1, bad)] * 30 + [(7, None)], "doc_id bigint, text string").withColumns({"label": F.lit(3), "held_out": F.lit("x"), "id": F.lit(0)})
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int")
    texts, toxic, _ = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 5, 2000)
    assert len(texts) == len({k for k in range(40) if zlib.crc32(str(k).encode()) % 5}) and any(len(t) > 20_000 for t in texts)
    assert toxicity.score_toxicity(docs, labels).count() == 71


def test_weighted_recall_against_brute_force(spark):
    rng = random.Random(14)
    word = lambda: f"w{int(rng.paretovariate(0.4)) % 20_000}"
    rows = []
    for _ in range(70):
        base = [word() for _ in range(rng.choice([80, 200, 500]))]
        for copy in range(7):
            text = list(base)
            for _ in range(copy and rng.randrange(1, max(2, len(base) // 40))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = near_dup.Sets(near_dup.inverse_frequencies(docs.select("text")), 1)
    held = [sets.weighted(t.encode().lower().split()) for _, t in rows]
    links = [(s, a, b) for a, b in itertools.combinations(range(len(rows)), 2) if a // 7 == b // 7 and (s := near_dup.similarity(held[a], held[b])) < 1]
    of = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    for least in (0.8, 0.9):
        pairs = [(a, b) for s, a, b in links if s >= least]
        assert sum(of[a] == of[b] for a, b in pairs) >= 0.98 * len(pairs) > 50, (least, len(pairs))
    assert all(a // 7 == b // 7 for a, b in of.items())


def test_links_between_members_that_never_lead_are_found(spark):
    """A chain of revisions: each is like the next, hardly any like the text that shares the most buckets."""
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randrange(10**6))
    rows = []
    for chain in range(6):
        text = [word() for _ in range(300)]
        for step in range(12):
            rows.append((chain * 100 + step, " ".join(text)))
            at = rng.randrange(280)
            text[at : at + 14] = [word() for _ in range(14)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sets = {i: shingles(t) for i, t in rows}
    of = {r.doc_id: r.class_id for r in got}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.83 * len(sets[a] | sets[b])]
    assert len(links) > 60 and all(of[a] == of[b] for a, b in links)


def test_pipeline_takes_nulls_empty_tables_repeats_and_clashing_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + "."
    one, two = text(), text()
    rows = [(1, one), (2, one.upper()), (3, two), (3, two), (4, None), (5, ""), (None, text()), (6, "x" * 100_000), (7, "語" * 5_000)]
    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame(rows, schema).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint"), "id": F.lit(1), "row": F.lit("r"), "kept": F.lit(0), "digest": F.lit(0), "node": F.lit(0), "label": F.lit(0)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {2, 3, None} or {r.doc_id for r in got} == {1, 3, None}
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0


STORY = "Paragraph of the story, which goes on for a while, and says more than any teaser does. "


def test_an_article_keeps_all_that_it_holds():
    e = html_extract.extract
    short = "<ul><li>one<li>two</ul><figure><figcaption>cap</figcaption></figure><dl><dt>t<dd>d</dl><table><tr><td>cell</table>"
    for text in (f"<p>{STORY * 30}</p>", f"<p>{STORY}</p>" * 30):
        assert e(f"<body><nav>n</nav><article>{text}{short}</article><footer>f</footer></body>").split("\n")[-6:] == ["one", "two", "cap", "t", "d", "cell"]
    for tag in ("<div class=comment>", "<p class=notice>", "<section class=search>"):
        assert STORY.strip() in e(f"<body><article><p>Begin of it, well.</p><p>And on.</p>{tag}{STORY * 5}</article></body>")
    deep = f"<body><article>{'<div>' * 100}<p>{STORY}</p>{'</div>' * 100}<p>Last.</p></article><p>{STORY}</p></body>"
    assert e(deep).split("\n") == [STORY.strip(), "Last."]


def test_what_is_no_article_goes():
    e = html_extract.extract
    told = [STORY.strip()] * 6
    assert e(f"<body>{f'<div>{STORY}</div>' * 6}<div class=bottom>Copyright 2024 ACME</div></body>").split("\n") == told
    talk = "<div class=talk>" + "<div><b>Joe</b> Nice one, thanks.</div>" * 5 + "</div>"
    assert e(f"<body><div class=story>{f'<p>{STORY}</p>' * 6}</div>{talk}</body>").split("\n") == told
    assert e(f"<body><div class=ad>{STORY}</div><article><h1>Title.</h1><p>Short one.</p></article></body>") == "Title.\nShort one."
    inside = "<div class=ad>Buy now, today!</div><ul><li><a href=/a>Go here, now.</a><li><a href=/b>And here.</a></ul>" + "<div class=comment>Nice, I say.</div>" * 3
    assert e(f"<body><article>{f'<p>{STORY}</p>' * 6}{inside}</article></body>").split("\n") == told


@pytest.mark.parametrize("page", ["<b>" * 10_000 + "<li></li>" * 10_000, "<span>" * 10_000 + "<a>x</a>" * 10_000, "<section><p>x" * 15_000, "<div class=a><b>x" * 12_000, "<table><tr><td>" * 13_000, "<li>x" * 40_000])
def test_pages_of_any_mix_of_tags_take_linear_time(page):
    import time

    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 4


def test_pairs_that_meet_in_tiles_are_those_of_the_bounds(spark):
    rng = random.Random(21)
    rows, samples, t = [], [], 0.8
    for k in range(900):
        node, total = k.to_bytes(16, "big"), rng.choice([1.0, 5.0, 5.05, rng.uniform(4, 9)])
        rows.append((rng.randrange(2), node, (rng.choice([0, 0, 0, rng.randrange(40)])).to_bytes(16, "big"), rng.uniform(t, 1) * total, total))
        samples.append((node, b""))
    buckets = near_dup.by_total(spark.createDataFrame(rows, "key bigint, node binary, label binary, behind double, total double"), t)
    met = near_dup.tiles(buckets, spark.createDataFrame(samples, "node binary, samples binary")).collect()
    sides = {}
    for r in met:
        sides.setdefault((r.key, r.i, r.j), ([], []))[r.lead].append((bytes(r.node), bytes(r.label)))
    found = {frozenset((a, b)) for others, leads in sides.values() for a, la in leads for b, lb in others if la != lb}
    want = {frozenset((a[1], b[1])) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[2] != b[2] and min(a[3], b[3]) >= t / (1 + t) * (a[4] + b[4])}
    assert len(want) > 1_000 and want <= found
    # just under the threshold no set may be the lighter one: nothing is compared, however many there are
    under = [(1, k.to_bytes(16, "big"), k.to_bytes(16, "big"), 0.88 * x, x) for k, x in enumerate([5.0, 5.01] * 1500)]
    samples = spark.createDataFrame([(node, b"") for _, node, *_ in under], "node binary, samples binary")
    under = near_dup.by_total(spark.createDataFrame(under, "key bigint, node binary, label binary, behind double, total double"), t)
    assert near_dup.tiles(under, samples).count() == 0


def test_one_payload_on_most_pages_has_one_response(spark):
    df = spark.createDataFrame([(k, "u", "same" if k % 3 else f"own {k}") for k in range(600)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()}
    assert got == {k: ("response", None) if k % 3 == 0 or k == 599 else ("revisit", 599) for k in range(600)}


def test_tiles_are_whole_across_batches():
    """Leads and others of a tile meet where a batch ends within it; a tile without either gives nothing."""
    import pyarrow as pa

    rows = [(1, 0, 0, True, b"a"), (1, 0, 0, True, b"b"), (1, 0, 0, False, b"c"), (1, 0, 0, False, b"d"), (2, 0, 0, True, b"e"), (3, 0, 1, False, b"f"), (4, 1, 0, True, b"g"), (4, 1, 0, False, b"h")]
    names = ["key", "i", "j", "lead", "node"]
    for width in range(1, len(rows) + 1):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[x : x + width], strict=True)], names) for x in range(0, len(rows), width)]
        got = [tuple(x.column(4).to_pylist() for x in tile) for tile in near_dup._by_tile(iter(batches))]
        assert got == [([b"a", b"b"], [b"c", b"d"]), ([b"g"], [b"h"])]


def test_near_duplicates_move_texts_and_no_larger_sets(spark, monkeypatch):
    """Sets take several times the room of short-worded texts; no table between steps holds a value that is larger than the texts."""
    rng = random.Random(9)
    rows = []
    for group in range(20):
        text = [rng.choice("abcdefghij") + str(rng.randrange(100)) for _ in range(300)]
        for copy in range(4):
            rows.append((group * 10 + copy, " ".join(text)))
            text[rng.randrange(300)] = f"z{copy}"
    largest, kept = {}, near_dup.materialize

    def recorded(df, name):
        out = kept(df, name)
        for c, kind in out.dtypes:
            if kind == "binary":
                largest[name, c] = max(largest.get((name, c), 0), out.agg(F.max(F.octet_length(c))).first()[0] or 0)
        return out

    monkeypatch.setattr(near_dup, "materialize", recorded)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.class_id == r.doc_id // 10 * 10 for r in got)
    assert max(largest.values()) <= max(len(t) for _, t in rows), largest


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, near_dup.drop_near_copies])
def test_small_tables_of_the_dedup_stages_are_few_files(spark, tmp_path, monkeypatch, drop):
    """Every file costs processes on local disks: their number follows the texts and the cores, not the session's shuffle partitions."""
    rng = random.Random(11)
    rows = []
    for group in range(120):
        text = [f"w{rng.randrange(1000)}" for _ in range(60)]
        rows += [(group * 10 + k, " ".join(text[:50] + [f"z{k // 2}"] + text[50:])) for k in range(4)]
    session = spark.newSession()
    for k, v in {"shuffle.partitions": 61, "adaptive.coalescePartitions.enabled": "false"}.items():
        session.conf.set(f"spark.sql.{k}", v)
    number = itertools.count()
    for module in (common, exact_dedup):
        monkeypatch.setattr(module, "scratch_path", lambda _, name: f"file://{tmp_path}/{next(number)}/{name}")
    kept = drop(session.createDataFrame(rows, "doc_id bigint, text string").coalesce(2))
    kept.write.parquet(f"{tmp_path}/out")
    assert session.read.parquet(f"{tmp_path}/out").count() == (240 if drop is exact_dedup.drop_exact_copies else 120)
    files = collections.Counter(p.parent.relative_to(tmp_path) for p in tmp_path.rglob("part-*.parquet"))
    assert max(files.values()) <= 8 * spark.sparkContext.defaultParallelism, files.most_common(5)
    assert sum(n <= 2 * spark.sparkContext.defaultParallelism + 2 for n in files.values()) >= len(files) - 3, files
