"""Countries to their two-letter codes, by a table of names."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import names_in, spaced

#: Everyday names that are no official ones.
EVERYDAY = {"usa": "US", "u.s.a.": "US", "uk": "GB", "great britain": "GB", "england": "GB", "uae": "AE", "holland": "NL", "korea": "KR", "türkiye": "TR", "turkey": "TR"}
LANGUAGES = ("en", "tr", "de", "fr", "es", "it", "pt", "nl")
_ACCENTED = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def without_accents(x: Column) -> Column:
    return F.translate(x, "".join(_ACCENTED), _PLAIN)


def country_names(spark: SparkSession, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """name, code: every country's names in the given languages as the JVM's locale data has them; some 250 rows a language."""
    locale = spark._jvm.java.util.Locale
    codes = list(locale.getISOCountries())
    names = {(locale("", c).getDisplayCountry(locale(language)).lower(), c) for c in codes for language in languages} | set(EVERYDAY.items())
    return spark.createDataFrame(sorted(names), "name string, code string")


def _lookup(names: DataFrame) -> DataFrame:
    """key, code: names, and codes themselves, which come first where a name reads like one."""
    keyed = names.select(F.lower(F.trim("name")).alias("key"), "code", F.lit(1).alias("rank"))
    codes = names.select(F.lower("code").alias("key"), F.upper("code").alias("code"), F.lit(0).alias("rank"))
    return keyed.unionByName(codes).filter("key != ''").groupBy("key").agg(F.min_by("code", F.struct("rank", "code")).alias("code"))


def with_country_code(df: DataFrame, column: str, names: DataFrame, into: str = "country_iso") -> DataFrame:
    """df with the code of the country that ``column`` names: a code itself, a name, or a name without its accents; null if unknown. Case,
    brackets and runs of white space do not count. names: name, code; its size decides how it is joined."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(column))), r"[()\[\]{}]", ""), r"\s+", " "))
    table = _lookup(names)
    exact = table.select(F.col("key").alias("_key"), F.col("code").alias("_code"))
    plain = table.filter("length(key) > 2").select(F.col("key").alias("_plain"), F.col("code").alias("_other"))
    out = df.withColumn("_k", cleaned).join(exact, F.col("_k") == F.col("_key"), "left")
    out = out.join(plain, without_accents(F.col("_k")) == F.col("_plain"), "left")
    return out.withColumn(into, F.coalesce("_code", "_other")).select(*df.columns, into)


def country_of(text: Column, names: dict[str, str]) -> Column:
    """The code of the longest country name in a text (the least of equals), else of its first pair of capitals if that is a code, else
    null. Within the row: one pattern holds all names. names: code by name."""
    by_name: dict[str, str] = {}
    for name, code in sorted(names.items(), key=lambda x: (x[0], x[1].upper())):
        key = " ".join(re.findall(r"\w+", name.lower()))
        if key:
            by_name[key] = min(by_name.get(key, code.upper()), code.upper())
    text = F.coalesce(text, F.lit(""))
    found = names_in(spaced(text), by_name)
    best = F.array_min(F.transform(found, lambda n: F.struct((-F.length(n)).alias("n"), n.alias("name"))))["name"]
    named = F.try_element_at(F.from_json(F.lit(json.dumps(by_name)), "map<string,string>"), best)
    pair = F.regexp_extract(text, "(?<![A-Za-z0-9_])([A-Z]{2})(?![A-Za-z0-9_])", 1)
    return F.coalesce(named, F.when(pair.isin(*sorted(set(by_name.values()))), pair)) if by_name else F.lit(None).cast("string")


def countries_in(df: DataFrame, id_col: str, text_col: str, names: DataFrame | dict[str, str], most: int = 20_000) -> DataFrame:
    """id, code: country_of() of each text; texts without one have no row, and a null text holds none. names: code by name, or a table
    of name and code with ``most`` rows at most, which goes into the pattern."""
    if isinstance(names, DataFrame):
        rows = names.select("name", "code").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} names")
        names = {}
        for r in rows:
            names[r.name] = min(names.get(r.name, r.code), r.code)
    return df.select(F.col(id_col).alias("id"), country_of(F.col(text_col), names).alias("code")).filter("code is not null")
