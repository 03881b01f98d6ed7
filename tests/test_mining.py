"""Mined text and pages on hand-made cases."""

from pyspark.sql import functions as F

from rosterflow.functions import mining


def one(spark, **columns):
    names = list(columns)
    df = spark.range(1).select(*[columns[n].alias(n) for n in names])
    return df.first()


def test_names_and_positions(spark):
    name = lambda e, c: mining.person_name(F.lit(e), F.lit(c))
    r = one(
        spark, desk=name("info@x.com", "Ann Lee - CEO"), context=name("al@x.com", "Ann Lee - CEO"), labelled=name("al@x.com", "contact: Ann Lee"),
        mailbox=name("ann.lee@x.com", None), nothing=name("al@x.com", "no name here"), titled=name("bo.ek@x.com", "Dr Lee - x"),
        position=mining.position_of(F.lit("Ann Lee, Sales Manager, Acme")), role=mining.position_of(F.lit("role: weaver, x")), none=mining.position_of(F.lit("x"))
    )
    assert r.desk is None and r.nothing is None
    assert tuple(r.context) == tuple(r.labelled) == tuple(r.mailbox) == ("Ann", "Lee")
    assert tuple(r.titled) == ("Bo", "Ek")
    assert (r.position, r.role, r.none) == ("Sales Manager", "role: weaver", None)


def test_industries(spark):
    of = lambda x: mining.industry_of(F.lit(x), {"tech": "Technology", "it": "Technology", "pharma": "Healthcare"}, ("Technology", "Energy"))
    r = one(spark, a=of(" IT "), b=of("energy"), c=of("biopharma"), d=of(" Weaving "), e=of("  "), f=of("fit"))
    assert tuple(r) == ("Technology", "Energy", "Healthcare", "Weaving", None, "fit")


def test_templates(spark):
    fields = F.create_map(F.lit("name"), F.lit("$1 A"), F.lit("company"), F.lit(""))
    r = one(
        spark, a=mining.render(F.lit("Hi {{NAME}}, {{company|\"friend\"}} {{other}}!"), fields), b=mining.render(F.lit("{{company|x}}"), fields),
        c=mining.render(F.lit("plain"), fields), d=mining.render(F.lit(None).cast("string"), fields), e=mining.render(F.lit("{{company | name}}"), fields),
    )
    assert tuple(r) == ("Hi $1 A, friend {{other}}!", "", "plain", "", "$1 A")


def test_suspicion(spark):
    full = {"email": "a@acme.com", "contact_name": "Ann Lee", "company_name": "Acme", "phone": "+49 30 1234", "website": "https://www.acme.com", "country": "France", "city": "Paris", "address": "x", "job_title": "y"}
    score = lambda source, evidence=True, **changed: mining.suspicion({k: F.lit(v).cast("string") for k, v in (full | changed).items()}, F.lit(source), F.lit(evidence))
    r = one(spark, clean=score("tableMiner"), made=score("aiMiner", False), name=score("x", contact_name="John Doe"), phone=score("x", phone="1111111"), city=score("x", country="Japan"), site=score("x", website="https://other.com"), empty=score("x", **dict.fromkeys(full)))
    assert tuple(r) == (0, 50, 40, 50, 25, 15, 0)


def test_page_verdicts(spark):
    b, n = (lambda x: F.lit(x)), F.lit
    score = lambda **k: mining.mineability(**{x: (b(v) if isinstance(v, bool) else n(v)) for x, v in (dict(reachable=True, is_pdf=False, emails=0, exhibitors=False, tables=0, links=0, blocked=False, login=False, scripted=False, kilobytes=9) | k).items()})
    crawl = lambda c, e, w: mining.deep_crawl(n(c), n(e).cast("double"), n(w))
    r = one(spark, plain=score(), rich=score(emails=11, exhibitors=True, tables=1, links=51), blocked=score(blocked=True), pdf=score(is_pdf=True, kilobytes=1), a=crawl(501, 0.5, 0), b=crawl(501, 0.4, 0), c=crawl(20, 0.1, 0), d=crawl(9, None, 1), e=crawl(10, None, 1))
    assert tuple(r) == (30, 100, 0, 50, "skip", "limited", "full", "full", "skip")


def test_foreign_addresses_and_page_hashes(spark):
    foreign = lambda url, mails, k: mining.foreign_only(F.lit(url), F.array(*[F.lit(m) for m in mails]), F.lit(k))
    c = lambda e, co, na: F.struct(F.lit(e).cast("string").alias("email"), F.lit(co).cast("string").alias("company_name"), F.lit(na).cast("string").alias("contact_name"))
    r = one(spark, yes=foreign("https://www.fair.com/x", ["a@dlg.org"], 1), own=foreign("https://fair.com", ["a@dlg.org", "b@fair.com"], 2), many=foreign("https://fair.com", ["a@dlg.org"], 3), bad=foreign("nonsense", ["a@dlg.org"], 1), hash=mining.page_hash(F.array(c("B@x.com", None, "Bo"), c("a@x.com", "Acme", "Ann"))))
    assert tuple(r) == (True, False, False, False, "a@x.com|acme::b@x.com|bo")


def test_merges_equal_the_fold_one_by_one(spark):
    """Shared mailboxes: ties of confidence and length, rows without e-mail, nulls, and a key with most rows."""
    import random

    from rosterflow.operators import merge

    rnd = random.Random(4)
    texts = ("contact_name", "company_name", "phone")
    rows = [
        (k, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([None, "", "m@x.co", "M@X.co"]), *[rnd.choice([None, "", "x", "y", "xx", "yy", "zzz"]) for _ in texts], rnd.choice([None, [], ["p"], ["q", "p"], ["r"]]), f"s{k}", rnd.choice([None, 0, 5, 20, 20, 25, 60]))
        for k in range(120)
    ]
    rnd.shuffle(rows)

    def pick(x, y):
        return (y or None) if not x else x if not y or len(x) >= len(y) else y

    def fold(key, settled):
        acc = None
        for r in sorted(r for r in rows if r[1] == key):
            b = [r[2] or None, *[t or None for t in r[3:6]], list(r[6] or []), r[7], r[8]]
            if acc is None:
                acc = b
                continue
            first = bool(acc[0]) if bool(acc[0]) != bool(b[0]) else (acc[6] or 0) >= (b[6] or 0)
            x, y = (acc, b) if first else (b, acc)
            confidence = max((c for c in (x[6], y[6]) if c is not None), default=None)
            acc = [x[0] or y[0], *[pick(x[k], y[k]) for k in (1, 2, 3)], x[4] + [o for o in y[4] if o not in x[4]], x[5], settled or confidence]
        return tuple(acc)

    schema = "ord int, k string, email string, contact_name string, company_name string, phone string, additional_emails array<string>, source string, confidence int"
    for settled in (None, 60):
        got = merge.merge_contacts(spark.createDataFrame(rows, schema), "k", settled=settled).collect()
        assert {r.k: (r.email, r.contact_name, r.company_name, r.phone, r.additional_emails, r.source, r.confidence) for r in got} == {k: fold(k, settled) for k in "abc"}
        assert sum(r.merged for r in got) == sum(r[1] is not None for r in rows)


def test_labels_in_every_language(spark):
    from rosterflow.operators import miners

    lines = {"Organisation: X": "company", "bedrijf - X": "company", "公司: X": "company", "имя : X": "name", "Yetkili Kişi: X": "name", "담당자: X": "name", "メールアドレス: a@b.co": "email", "адрес: X": "address", "Straße: X": "address",
             "tél: 1": "phone", "Cep Telefonu: 1": "phone", "موقع الويب: X": "website", "국가: X": "country", "市: X": "city", "cargo: X": "title", "country/region: X": "country", "note: X": None, "companyx: X": None, "company X": None, "city: a@b.co": "email"}
    df = spark.createDataFrame(list(lines.items()), "text string, want string")
    assert [(r.text, r.f) for r in df.select("text", miners.label_of(F.col("text"))["field"].alias("f")).collect()] == list(lines.items())


def test_candidates_keep_numbered_mailboxes(spark):
    from rosterflow.operators import miners

    emails = ["Desk99999@plain.net, desk100000@plain.net,desk1350000@plain.net", "1234567@bulk.net", "x1@shop.example", "q@tiny.io", None]
    got = miners.candidates(spark.createDataFrame([(e,) for e in emails], "emails string")).collect()
    assert sorted(r.email for r in got) == ["desk100000@plain.net", "desk1350000@plain.net", "desk99999@plain.net"]


def test_rows_of_one_split_are_mined_by_several_tasks(spark):
    from rosterflow.operators import html_miners as hm
    from rosterflow.operators import miners

    s = F.col("id").cast("string")
    one_split = spark.range(0, 64, 1, 1)
    labels = miners.mine_labels(one_split.select("id", F.concat(F.lit("Name: Ann\nE-mail: a"), s, F.lit("@x.co")).alias("text")))
    directory = hm.mine_directory(one_split.select("id", F.concat(F.lit("<b>Firm</b><br><b>Email:</b> a"), s, F.lit("@x.co<br>")).alias("html")), "id")
    cards = hm.mine_cards(one_split.select("id", F.concat(F.lit('<div class="card"><b>Firm</b> a'), s, F.lit("@x.co</div>")).alias("html")), "id")
    for mined in (labels, directory, cards):
        rows = mined.select("id", "email", F.spark_partition_id().alias("task")).collect()
        assert sorted((r.id, r.email) for r in rows) == [(i, f"a{i}@x.co") for i in range(64)]
        assert len({r.task for r in rows}) > 1


def test_trees_leave_a_batch_in_slices():
    import pyarrow as pa

    from rosterflow.operators import page_cards as pc

    pages = ["<p>" + "<b>x</b> " * 20_000, None, "", "<p>y", *["<p>" + "z" * 100_000] * 12]
    got = list(pc.tree_batches(iter([pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["id", "html"])])))
    rows = [r for b in got for r in b.to_pylist()]
    names = ("tag", "parent", "size", "start", "stop", "chars", "nearest", "href")
    want = [pc.tree_of(p) for p in pages]
    assert [r["id"] for r in rows] == list(range(len(pages)))
    assert [[tuple(e[n] for n in names) for e in r["elements"]] for r in rows] == [es for es, _ in want]
    assert [[(p["owner"], p["text"]) for p in r["pieces"]] for r in rows] == [ps for _, ps in want]
    assert max(sum(len(pages[i] or "") for i in b.column(0).to_pylist()) for b in got) <= pc.SLICE + 100_004 and len(got) == 3


def test_tables_in_texts(spark):
    from rosterflow.operators import tables

    texts = [
        (1, "Hello, all\n\nName\tE-mail\tFirm\nANN LEE\tAnn@X.co\tacme\n\tnone\tb\nJo\tjo@x.co\t\nbye"),
        (2, 'x\n"Lee, Ann",ann@x.co,www.acme.com\n"Poe, Ed",ed@x.co,www.poe.com\n'),
        (3, "| a@x.co | Acme Ltd | Germany |\n| b@x.co | Bolt GmbH | France |\n| | Cog Inc | Spain |"),
        (4, "Write to us, or to a@x.co\nWe wait, and answer"), (5, None), (6, ""), (7, "a@x.co,b"), (8, "a@x.co\tAcme Ltd\n\nb@x.co\tBolt Ltd"), (9, "x," * 3000 + "a@x.co\n" + "y," * 3000 + "b@x.co"),
    ]
    got = {(r.id, r.line): r for r in tables.mine_tables(spark.createDataFrame(texts, "id int, text string")).collect()}
    assert sorted(got) == [(1, 3), (1, 5), (2, 1), (2, 2), (3, 0), (3, 1), (9, 0), (9, 1)]
    assert (got[1, 3].name, got[1, 3].email, got[1, 3].company, got[1, 5].company) == ("Ann Lee", "ann@x.co", "Acme", None)
    assert (got[2, 1].website, got[2, 1].email) == ("https://www.acme.com", "ann@x.co") and (got[3, 1].company, got[3, 1].country) == ("Bolt GmbH", "France")


def test_values_by_kind(spark):
    from rosterflow.operators import tables

    kinds = {"a@b.co": "email", "+49 (30) 1234567": "phone", "https://x": "website", "acme.io": "website", "Germany": "country", "Acme Corp": "company", "Social Media Ads": "source", "Ann Lee": "name", "Ann": None, "": None, None: None, "12": None}
    df = spark.createDataFrame(list(kinds.items()), "v string, want string")
    assert [(r.v, r.k) for r in df.select("v", tables.value_kind(F.col("v")).alias("k")).collect()] == list(kinds.items())


def test_miners_take_turns(spark, tmp_path):
    from rosterflow.operators import miners, tables

    texts = [(1, "Name: A\nMail: a@x.co"), (2, "N\ta@x.co\nM\tb@x.co"), (3, "just c@x.co"), (4, "nothing"), (5, None), (6, "  ")]
    asked = []

    def keep(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def seen(name, miner):
        def run(df, *a):
            asked.append((name, df.count()))
            return miner(df, *a)

        return name, run

    states, found = tables.mine_in_turn(spark.createDataFrame(texts, "id int, text string"), [seen("labels", miners.mine_labels), seen("tables", tables.mine_tables), seen("addresses", miners.mine_addresses)], keep)
    assert sorted(map(tuple, states.collect())) == [(1, "SUCCESS", "labels", 1), (2, "SUCCESS", "tables", 2), (3, "SUCCESS", "addresses", 1), (4, "FAILED", "addresses", 0), (5, "EMPTY", None, 0), (6, "EMPTY", None, 0)]
    assert asked == [("labels", 4), ("tables", 3), ("addresses", 2)] and found.count() == 4


def test_reconcile(spark):
    from rosterflow.operators import rules

    ts = lambda df, *cs: df.withColumns({c: F.col(c).cast("timestamp") for c in cs})
    day = lambda d: f"2024-01-{d:02d}"
    events = [(1, 1, "open", day(28), None), (2, 1, "open", day(29), None), (3, 2, "click", day(30), "http://x/pricing"), (4, 3, "open", day(1), None), (5, 4, "reply", day(30), None), (6, 4, "open", day(30), None), (7, 5, "open", day(20), None), (8, 5, "open", day(21), None)]
    events = ts(spark.createDataFrame([(i, p, k, t, u, 1) for i, p, k, t, u in events], "id int, person_id int, event_type string, occurred_at string, url string, campaign_id int"), "occurred_at")
    items = [(2, "engaged_hot", "old", 1, day(1), 0, "snoozed", day(30)), (3, "sequence_exhausted", "old", 1, day(1), 7, "open", None), (4, "engaged_hot", "old", 1, day(1), 7, "done", None)]
    columns = "person_id int, trigger_reason string, trigger_detail string, campaign_id int, last_activity_at string, engagement_score long, status string, snoozed_until string"
    items = ts(spark.createDataFrame(items, columns), "last_activity_at", "snoozed_until")
    sequences = ts(spark.createDataFrame([(1, 3, "completed", 4, day(9)), (1, 4, "completed", 4, day(9)), (1, 5, "completed", 2, day(9)), (9, 1, "completed", 2, day(9)), (1, 2, "active", 1, day(9))], "campaign_id int, person_id int, status string, last_sent_step int, updated_at string"), "updated_at")
    campaigns = spark.createDataFrame([(1,)], "id int")
    got = rules.reconcile(items, events, sequences, campaigns, "2024-01-31").collect()
    assert sorted((r.person_id, r.trigger_reason, r.status, r.engagement_score) for r in got) == [
        (1, "engaged_hot", "open", 2), (2, "engaged_hot", "open", 3), (3, "sequence_exhausted", "open", -1), (4, "engaged_hot", "done", 7), (5, "sequence_exhausted", "open", 0),
    ]
    assert next(r for r in got if r.person_id == 5).trigger_detail == "Sequence completed — no response after 2 emails"
    assert {r.person_id for r in rules.changed_people(events, "2024-01-29 00:00:00", "2024-01-31").collect()} == {2, 4} and {r.person_id for r in rules.changed_people(events, "2024-01-25 00:00:00", "2024-01-31").collect()} == {1, 2, 4, 5}


def test_page_cards(spark):
    import time

    from rosterflow.operators import page_cards as pc

    pages = [
        (1, '<table><tr><th>Firm<td>Acme<tr><td>Name</td><td>Eva Roth</td><td>E-Mail:</td><td>eva@acme.de</td></tr></table>'),
        (2, "<div>short <span>x@yy.de</span></div>"), (3, None), (4, ""), (5, "<p>no-reply@y.de</p><b>z@y.de</b>"),
        (6, "<script>a@script.de</script><ul><li>Tel: +49 30 1234567<li><b>Bolt</b><div><div>info@bolt.de</div></div></ul></div></p>"),
        (7, '<li><a href="mailto:Q@y.de">q@y.de</a> City: Bonn</li><li>q@y.de<br>Country: Peru</li>'),
    ]
    got = {(r.id, r.email): r for r in pc.mine_page_cards(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert sorted(got) == [(1, "eva@acme.de"), (2, "x@yy.de"), (6, "info@bolt.de"), (7, "q@y.de")]
    assert (got[1, "eva@acme.de"].name, got[1, "eva@acme.de"].company) == ("Eva Roth", "Acme")
    assert got[6, "info@bolt.de"].company == "Bolt" and got[6, "info@bolt.de"].phone is None and got[2, "x@yy.de"].company == "Yy" and got[7, "q@y.de"].country == "Peru"
    for odd in ("<b>" * 20000 + "<li></li>" * 20000, "<span>" * 20000 + "<a>x</a>" * 20000, "</p>" * 50000, "<p>" * 50000, "<td>x" * 50000):
        start = time.process_time()
        elements, _ = pc.tree_of(odd)
        assert time.process_time() - start < 5 and all(e[1] < k for k, e in enumerate(elements))


def test_candidates_around_addresses(spark):
    from rosterflow.operators import normalize as nz

    texts = [
        (1, "Acme tools | Sales Director\nContact: Eva Roth, eva@acme.de, +49 30 1234567, Peru"), (2, "john.smith@firm.co.uk wrote. noreply@x.de a@b.png x@test.example.com"), (3, None), (4, ""),
        (5, "info@mail.com öLead https://facebook.com/x https://own.io/a BR " + "w " * 40 + "info@mail.com"), (6, "a@b.de, " * 3000),
    ]
    got = {(r.id, r.email): r for r in nz.candidates_of(spark.createDataFrame(texts, "id int, text string"), {"peru": "PE", "brazil": "BR"}).collect()}
    assert sorted(got) == [(1, "eva@acme.de"), (2, "john.smith@firm.co.uk"), (5, "info@mail.com"), (6, "a@b.de")]
    one, two, five = got[1, "eva@acme.de"], got[2, "john.smith@firm.co.uk"], got[5, "info@mail.com"]
    assert (one.first_name, one.last_name, one.company_name, one.country_code, one.website) == ("Eva", "Roth", "Acme tools", "PE", "https://acme.de") and one.position.startswith("Sales")
    assert (two.first_name, two.last_name, two.company_name) == ("John", "Smith", "Firm") and (five.first_name, five.website, five.country_code) == (None, "https://own.io/a", "BR")
