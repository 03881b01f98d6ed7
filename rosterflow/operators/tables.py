"""Contacts from tables in texts: lines with tabs, bars or commas, whose columns are told by a header or by a vote of their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import email as em
from .miners import FIELDS, field_of

#: What tells a cell's kind, asked in this order.
COUNTRIES = ("turkey", "germany", "france", "usa", "uk", "china", "india", "spain", "italy")
COMPANY = r"(?i)\b(ltd|inc|corp|llc|gmbh|ag|co\.|company|limited|group|plc|sa|srl|bv|nv)\b"
SOURCE = r"(?i)\b(social media|web search|referral|email marketing|organic|paid|direct|cold call|trade show|exhibition|expo|fair|ads|seo|sem|ppc|inbound|outbound)\b"
KINDS = ("email", "phone", "website", "country", "company", "source", "name")
#: A cell of a comma line may be quoted; quotes within are doubled.
COMMA_CELL = r'(?:^|,)\s*("(?:[^"]|"")*"|[^,]*)'


def value_kind(x: Column) -> Column:
    """email, phone, website, country, company, source or name, or null: what a cell's value looks like, firms and sources before names."""
    s = F.trim(x)
    words = F.size(F.split(s, r"\s+"))
    return (
        F.when(F.coalesce(s, F.lit("")) == "", None).when(em.is_valid(F.lower(s)), "email").when(s.rlike(r"^[\d\s\-+()]{8,20}$"), "phone")
        .when(s.rlike(r"(?i)^(https?://|www\.)|\.(com|org|net|io|app)$"), "website").when(F.lower(s).rlike("|".join(COUNTRIES)), "country")
        .when(s.rlike(COMPANY), "company").when(s.rlike(SOURCE), "source").when(s.rlike(r"^[A-Za-zÀ-ɏ\s]{2,50}$") & words.between(2, 4), "name")
    )


def clean_value(field: str, x: Column) -> Column:
    """A cell without outer quotes; a site gets its scheme, a name or firm in one case gets capitals, an address is bare and in lower case."""
    s = F.trim(F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    if field == "email":
        return F.lower(F.coalesce(F.nullif(F.regexp_extract(s, em.PATTERN, 0), F.lit("")), s))
    if field == "website":
        site = F.concat(F.when(F.startswith(s, F.lit("www.")), "https://").otherwise("https://www."), s)
        return F.when(~F.startswith(s, F.lit("http")) & s.contains("."), site).otherwise(s)
    if field in ("name", "company"):
        return F.when((s == F.upper(s)) | (s == F.lower(s)), F.regexp_replace(F.initcap(s), "^$", "")).otherwise(s)
    return s


def cells_of(text: Column) -> Column:
    """struct(mark, cells): a line's cells by the first of tab, bar and comma in it, trimmed; bars at its ends part nothing."""
    bare = F.regexp_replace(text, r"^\s*\||\|\s*$", "")
    unquoted = lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    commas = F.transform(F.regexp_extract_all(text, F.lit(COMMA_CELL), F.lit(1)), unquoted)
    split = lambda x, by: F.split(x, by, -1)
    cells = F.when(text.contains("\t"), split(text, "\t")).when(text.contains("|"), split(bare, r"\|")).when(text.contains(","), commas)
    mark = F.when(text.contains("\t"), "tab").when(text.contains("|"), "bar").when(text.contains(","), "comma")
    return F.struct(mark.alias("mark"), F.transform(cells, lambda c: F.trim(c)).alias("cells"))


def mine_tables(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, line, and the fields of each row of a table that has an e-mail.

    A table is a run of two lines and more with one mark and two cells and more. Its first line is a header if it stands out: two of its
    cells or more are labels, and none is an address. A header's labels name the columns; without one a column is what more than half of
    its filled cells look like, the column with most votes where two claim a field. A run counts only if some column is its addresses: by
    header, or in at least half of its rows. Lines of a text meet in windows, no more than the text itself holds. Null texts hold nothing;
    id_col must tell texts apart.
    """
    # blanks at a line's ends are kept until its cells are parted, as tabs there part cells too
    raw = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\r?\n", -1)).alias("line", "text"))
    rows = raw.filter(F.col("text").rlike(r"[\t|,]")).withColumn("c", cells_of(F.col("text"))).filter(F.size("c.cells") >= 2).select("id", "line", "c.mark", "c.cells")
    rows = rows.withColumn("block", F.col("line") - F.row_number().over(Window.partitionBy("id", "mark").orderBy("line")))
    table = ["id", "mark", "block"]
    w = Window.partitionBy(*table)
    labels = F.size(F.filter(F.transform("cells", field_of), lambda f: f.isNotNull()))
    mails = F.exists("cells", lambda c: c.rlike(em.PATTERN))
    rows = rows.withColumns({"first": F.min("line").over(w), "lines": F.count("*").over(w), "hint": (labels >= 2) & ~mails, "mails": mails})
    rows = rows.filter("lines >= 2").withColumn("header", F.max(F.when(F.col("line") == F.col("first"), F.col("hint"))).over(w)).withColumn("some", F.max("mails").over(w)).filter("some")
    cells = rows.select(*table, "line", "header", (F.col("header") & (F.col("line") == F.col("first"))).alias("head"), F.posexplode("cells").alias("at", "value"))
    kind = F.when(~F.col("head"), value_kind(F.col("value")))
    votes = cells.withColumn("kind", kind).groupBy(*table, "header", "at").agg(
        F.max(F.when(F.col("head"), field_of(F.col("value")))).alias("label"), F.count_if(~F.col("head")).alias("rows"), F.count_if(~F.col("head") & (F.col("value") != "")).alias("filled"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
    )
    most = F.array_max(F.array(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)]))
    votes = votes.withColumn("most", most)
    enough = F.when(F.col("most.kind") == "email", 2 * F.col("most.n") >= F.col("rows")).otherwise(2 * F.col("most.n") > F.col("filled"))
    votes = votes.withColumn("field", F.when(F.col("header"), F.col("label")).when(enough & (F.col("most.n") > 0), F.col("most.kind"))).filter("field is not null")
    best = votes.withColumn("rank", F.row_number().over(Window.partitionBy(*table, "field").orderBy(F.desc(F.when(F.col("header"), 0).otherwise(F.col("most.n"))), "at"))).filter("rank = 1")
    found = cells.filter(~F.col("head")).join(best.select(*table, "at", "field"), [*table, "at"])
    fields = ("email", *[f for f in dict.fromkeys((*FIELDS, *KINDS)) if f != "email"])
    value = lambda f: F.max(F.when((F.col("field") == f) & (F.col("value") != ""), clean_value(f, F.col("value")))).alias(f)
    out = found.groupBy(*table, "line").agg(*[value(f) for f in fields])
    return out.filter(em.is_valid(F.col("email"))).select("id", "line", *fields)


def mine_in_turn(df: DataFrame, miners: list[tuple[str, object]], keep, id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Miners one after another, each over the texts in which those before it found nothing: (id, status, miner, contacts) for each text,
    and (id, miner, email) for each address found.

    miners: names and functions of (df, id_col, text_col) that give rows with id and email. keep(df, name) writes a stage's rows down and
    reads them again, so that no stage runs twice. SUCCESS ends a text's turns; a text that all miners leave empty has FAILED, with the last
    miner's name. A null or blank text is asked of none: EMPTY, without a miner. id_col must tell texts apart.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blank = F.trim(F.coalesce(F.col("text"), F.lit(""))) == ""
    left, done, found = texts.filter(~blank), texts.filter(blank).select("id", F.lit("EMPTY").alias("status"), F.lit(None).cast("string").alias("miner"), F.lit(0).cast("long").alias("contacts")), None
    for name, miner in miners:
        rows = keep(miner(left, "id", "text").select("id", F.lit(name).alias("miner"), F.lower("email").alias("email")).distinct(), name)
        done = done.unionByName(rows.groupBy("id").agg(F.lit("SUCCESS").alias("status"), F.lit(name).alias("miner"), F.count("*").alias("contacts")))
        left = left.join(rows.select("id").distinct(), "id", "left_anti")
        found = rows if found is None else found.unionByName(rows)
    failed = left.select("id", F.lit("FAILED").alias("status"), F.lit(miners[-1][0]).alias("miner"), F.lit(0).cast("long").alias("contacts"))
    return done.unionByName(failed), found
