"""Readers and sinks for the file shapes that contact data comes in. All go through Spark's readers, so that any store will do."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header names of list uploads, by the field they mean.
ALIASES = {
    "email": ("email", "e_mail", "mail", "email_address"),
    "first_name": ("first_name", "firstname", "given_name"),
    "last_name": ("last_name", "lastname", "surname", "family_name"),
    "name": ("name", "full_name", "contact_name", "contact"),
    "company": ("company", "company_name", "organization", "organisation", "firm"),
    "country": ("country", "country_name"),
    "phone": ("phone", "telephone", "tel", "mobile"),
    "website": ("website", "web", "url", "site"),
    "position": ("position", "title", "job_title", "role"),
}
#: Words of sheet headers, by field; the longest that a header holds decides.
HEADER_WORDS = {
    "email": ("email", "e-mail", "mail"), "company": ("company", "organization", "firma", "unternehmen"), "phone": ("phone", "telephone", "telefon", "tel", "mobile", "gsm"),
    "country": ("country", "land", "ülke"), "city": ("city", "stadt", "şehir"), "address": ("address", "adresse", "adres"), "website": ("website", "web", "url"),
    "title": ("title", "position", "job title"), "first_name": ("first name", "vorname"), "last_name": ("last name", "surname", "nachname"), "name": ("name", "contact"),
    "source": ("source", "quelle"),
}


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True) -> DataFrame:
    """CSV or, by its ending, TSV: quotes respected, one line a row, cells trimmed, everything text."""
    sep = sep or ("\t" if re.search(r"\.(tsv|tab)(\.gz)?$", path) else ",")
    df = spark.read.csv(path, sep=sep, header=header, quote='"', escape='"', multiLine=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in df.columns])


def normalize_header(name: str) -> str:
    return re.sub(r"[^a-z0-9_]", "_", name.strip().lower())


def canonical_upload(df: DataFrame) -> DataFrame:
    """A list upload in canonical fields: of a field's columns the first that is filled counts; a name is made of its parts if missing."""
    by_name: dict[str, list[str]] = {}
    for c in df.columns:
        by_name.setdefault(normalize_header(c), []).append(c)
    out = {}
    for field, names in ALIASES.items():
        cells = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for n in names for c in by_name.get(n, [])]
        out[field] = F.coalesce(*cells) if cells else F.lit(None).cast("string")
    made = F.nullif(F.concat_ws(" ", out["first_name"], out["last_name"]), F.lit(""))
    out["name"] = F.coalesce(out["name"], made)
    out["email"] = F.lower(out["email"])
    return df.select(*[v.alias(k) for k, v in out.items()])


def infer_header(rows: list[list[str]]) -> tuple[int, dict[int, str]] | None:
    """(row, field by column) of the first of at most five rows that names an e-mail column or two fields. An exact word wins, else the
    longest word that the cell holds; a field is taken once."""
    for at, row in enumerate(rows[:5]):
        found: dict[int, str] = {}
        for k, cell in enumerate(row):
            text = str(cell or "").strip().lower()
            exact = next((f for f, words in HEADER_WORDS.items() if text in words), None)
            held = max(((len(w), f) for f, words in HEADER_WORDS.items() for w in words if w in text), default=(0, None))[1]
            field = exact or held
            if field and field not in found.values():
                found[k] = field
        if "email" in found.values() or len(found) >= 2:
            return at, found
    return None


def read_sheet_like(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files whose header may stand in one of their first rows, in the fields that the header names. Each file has its own
    header, found among its first five rows; rows down to it go, and later rows that look like it stay. Without a header no row comes."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    cells = lines.withColumn("cells", F.transform(F.split("value", r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', ""))))
    # a file's first block is read by one task in the order of its lines, so that this number tells them apart there
    cells = cells.withColumn("row", F.monotonically_increasing_id())
    first = cells.filter("block = 0").withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("row"))).filter("rank <= 5")
    head = first.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("first"))

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(file, rows[h[0]]["row"], {f: k for k, f in h[1].items()}) for file, rows in zip(batch.file, batch["first"], strict=True) if (h := infer_header([list(x["cells"]) for x in rows]))]
            yield pd.DataFrame(found, columns=["file", "header", "places"])

    headers = head.mapInPandas(infer, "file string, header bigint, places map<string,int>")  # a row a file
    named = {r.field for r in headers.select(F.explode(F.map_keys("places")).alias("field")).distinct().collect()}
    fields = [f for f in HEADER_WORDS if f in named]  # no more than there are fields
    if not fields:
        return spark.createDataFrame([], "email string")
    rows = cells.join(headers, "file").filter((F.col("block") > 0) | (F.col("row") > F.col("header"))).filter(F.length("value") > 0)
    return rows.select(*[F.nullif(F.get("cells", F.col("places")[f]), F.lit("")).alias(f) for f in fields])


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, cells of every sheet. Needs a spreadsheet engine for pandas on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                for sheet, frame in pd.read_excel(io.BytesIO(content), sheet_name=None, header=None, dtype=str).items():
                    yield pd.DataFrame({"file": name, "sheet": sheet, "row": range(len(frame)), "cells": frame.fillna("").values.tolist()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, sheet string, row int, cells array<string>")


def loose_results(df: DataFrame) -> DataFrame:
    """Results of an API with loosely named fields: the first name that is there and filled counts."""
    have = set(df.columns)

    def first(*names: str):
        cells = [F.get(F.col(n), F.lit(0)) if dict(df.dtypes)[n].startswith("array") else F.col(n).cast("string") for n in names if n in have]
        return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cells]) if cells else F.lit(None).cast("string")

    return df.select(
        F.lower(first("email", "emails")).alias("email"), first("contactName", "contact_name", "name").alias("contact_name"), first("companyName", "company_name", "company").alias("company_name"),
        first("jobTitle", "job_title", "title").alias("job_title"), first("phone", "telephone").alias("phone"), first("website", "url").alias("website"), first("country").alias("country"), first("city").alias("city"), first("address").alias("address"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays joined by ', ', nulls empty, quotes doubled."""
    flat = [F.array_join(c, ", ").alias(c) if kind.startswith("array") else F.col(f"`{c}`") for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
