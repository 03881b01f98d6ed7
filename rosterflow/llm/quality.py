"""Line-first cleaning in DataFrame operations: rules judge each line, failing lines go, then documents that lost too much text go.

A null text has no words. Lines are split at \\n; a word is a run of characters other than white space (x20, x09-x0D).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP

#: Phrases of site furniture, matched in lower case.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "read more",
    "sign up", "log in", "subscribe to", "share this", "javascript", "follow us on", "skip to content", "back to top",
)
#: Characters that end a sentence, with what may follow them.
ENDINGS = r"[.!?:;…。！？]['\")\]»”’]*[\x20\x09-\x0D]*$"
SYMBOLS = r"[#*$%&|<>]"
BARS = r"[|•»›]"
#: A word four times in a row or more, with all its repeats.
STUTTER = r"(?<![^\x20])([^\x20]+)(?:\x20\1){3,}(?![^\x20])"
WINDOW = 8


def split_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def line_failure(line: Column, min_line_words: int = 5, max_symbols: float = 0.2, max_short_parts: int = 3, max_bars: float = 0.15, max_stutter: float = 0.3, phrase_words: int = 25) -> Column:
    """The first rule that a line breaks, or null. Blank lines break none.

    navigation: at least ``max_short_parts`` bars, bullets or guillemets, and more than ``max_bars`` a word; symbols: more marks and
    doubled exclamation marks than ``max_symbols`` a word; stutter: more than ``max_stutter`` of the words in runs of one word four times
    in a row or more; boilerplate: a phrase of BOILERPLATE for every ``phrase_words`` words or fewer; punctuation: fewer than
    ``min_line_words`` words and no sentence ending. Lines of every length are judged alike. Cheap tests stand before the counts they guard.
    """
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    # one word or more, but fewer than min_line_words: told by the line's first words
    few = r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){0,%d}[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$" % max(min_line_words - 2, 0)
    bars = F.regexp_count(line, F.lit(BARS))
    stuttered = F.size(F.split(F.array_join(F.regexp_extract_all(line, F.lit(STUTTER), F.lit(0)), " "), " "))
    phrases = "|".join(BOILERPLATE)
    return (
        F.when(line.rlike(BARS) & (bars >= max_short_parts) & (bars > words * max_bars), "navigation")
        .when(line.rlike(SYMBOLS + "|!!") & (F.regexp_count(line, F.lit(SYMBOLS + r"+|!!+")) > words * max_symbols), "symbols")
        .when(line.rlike(STUTTER) & (stuttered > words * max_stutter), "stutter")
        .when(F.lower(line).rlike(phrases) & (F.regexp_count(F.lower(line), F.lit(phrases)) * phrase_words >= words), "boilerplate")
        .when(line.rlike(few) & ~line.rlike(ENDINGS), "punctuation")
    )


def line_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = 0.5) -> DataFrame:
    """docs with the base counts, base_failed, clean_text and kept; every column of docs stays in ``row``, whatever its name. Repeated
    rows are judged once each; texts are judged whole, whatever their length, each in its own row.

    kept is false where base_failed (fewer than 20 words, or over 30 % of the words in repeated 8-word windows), else false where the
    removed lines held more than ``max_loss`` of the words.
    """
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("words", split_words(F.col("text")))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumns(
        {
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
            "lines": F.split("text", "\n", -1),
            "h1": F.transform("words", lambda w: F.xxhash64(w)),
        }
    )
    # 64-bit hashes of 2, 4 and 8 words; a window's is the hash of its halves'
    for a, b, n in (("h1", "h2", 1), ("h2", "h4", 2), ("h4", "h8", 4)):
        d = d.withColumn(b, F.expr(f"if(size({a}) <= {n}, array(), zip_with(slice({a}, 1, size({a}) - {n}), slice({a}, {n + 1}, size({a}) - {n}), (x, y) -> xxhash64(x, y)))")).drop(a)
    # Hashes that occur twice are neighbours once sorted; then only the windows that may hold one of them are sorted with their places.
    d = d.withColumn("sorted", F.expr("if(size(array_distinct(h8)) = size(h8), cast(array() as array<bigint>), sort_array(h8))"))
    d = d.withColumn("twice", F.expr("array_distinct(filter(zip_with(slice(sorted, 2, size(sorted)), sorted, (x, y) -> if(x = y, x, null)), x -> x is not null))")).drop("sorted")
    placed = "transform(h8, (h, i) -> named_struct('h', h, 'i', i))"
    d = d.withColumn("again", F.expr(f"case when size(twice) = 0 then cast(array() as array<struct<h:bigint,i:int>>) when size(twice) <= 200 then filter({placed}, e -> array_contains(twice, e.h)) else array_sort({placed}) end")).drop("h8")
    d = d.withColumn(
        "at",
        F.expr(
            "case when size(twice) <= 200 then transform(again, e -> e.i) else array_sort(transform(filter(transform(again, (e, k) -> named_struct('i', e.i, 'same', coalesce(get(again, k - 1).h = e.h, false) or coalesce(get(again, k + 1).h = e.h, false))), e -> e.same), e -> e.i)) end"
        ),
    ).drop("again", "twice")
    # each window adds its words up to the start of the next one
    d = d.withColumn("n_repeat_words", F.expr(f"aggregate(zip_with(at, slice(at, 2, size(at)), (a, b) -> coalesce(least({WINDOW}, b - a), {WINDOW})), 0L, (s, x) -> s + x)")).drop("at")
    d = d.withColumn("full_lines", F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_dup_lines", (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long"))
    d = d.withColumn("clean_lines", F.filter("lines", lambda x: line_failure(x).isNull())).withColumn("clean_text", F.array_join("clean_lines", "\n"))
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    left = F.when(F.size("clean_lines") == F.size("lines"), F.col("n_words")).otherwise(F.size(split_words(F.col("clean_text"))))
    return d.withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * (1 - max_loss))).drop("words", "lines", "full_lines", "clean_lines")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = 0.5) -> DataFrame:
    """One row per row of docs, with the counts and the verdict. Empty tables give empty results."""
    m = line_metrics(docs, id_col, text_col, max_loss)
    # a generator keeps a later filter from being pushed below the steps above, with a copy of them for each time they are named
    row = F.struct(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return m.select(F.inline(F.array(row)))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = 0.5, length_col: str = "n_chars") -> DataFrame:
    """The kept rows of docs with their failing lines removed; ``length_col``, where docs has it, follows the text."""
    m = line_metrics(docs, id_col, text_col, max_loss)
    fixed = {text_col: F.when(F.col("clean_text") == F.col("text"), F.col(f"row.`{text_col}`")).otherwise(F.col("clean_text"))}
    if length_col in docs.columns:
        fixed[length_col] = F.when(F.col("clean_text") == F.col("text"), F.col(f"row.`{length_col}`")).otherwise(F.length("clean_text")).cast(docs.schema[length_col].dataType)
    # here too rows go by a generator
    row = F.struct(*[fixed[c].alias(c) if c in fixed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return m.select(F.inline(F.when(F.col("kept"), F.array(row))))
