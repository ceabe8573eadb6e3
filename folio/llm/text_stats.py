"""Per-document text statistics as Spark expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import SPACE_CLASS, WORD_CLASS, unused

SYMBOLS = "[#*$%&|<>]"


def removed_count(c: Column, pattern: str) -> Column:
    """How many characters ``pattern``, a class of single characters, matches."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def with_words(df: DataFrame, text: str = "text", words: str = "words") -> DataFrame:
    """Adds the words of a text in order; a null text has none."""
    cut = F.split(F.coalesce(F.col(text), F.lit("")), f"{SPACE_CLASS}+")
    return df.withColumn(words, F.filter(cut, lambda w: w != ""))


def with_repeat_words(df: DataFrame, words: str = "words", out: str = "n_repeat_words", size: int = 5) -> DataFrame:
    """Adds the number of words that lie in a window of ``size`` words found twice or more in the text, first ones included.

    Hashes of the windows show which texts have any repeat; only those sort their windows. Windows are compared as
    strings, so a hash collision costs time but no error. No column of ``df`` but ``out`` is touched.
    """
    h, again, windows, places = (unused(df, f"_{k}") for k in ("hashes", "again", "windows", "places"))
    n = F.size(words)
    hashed = F.expr(f"transform(sequence(0, size({words}) - {size}), i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(size))}))")
    df = df.withColumn(h, F.when(n > size, hashed))
    df = df.withColumn(again, F.coalesce(F.size(F.array_distinct(h)) < F.size(h), F.lit(False)))
    window = F.expr(f"array_sort(transform(sequence(0, size({words}) - {size}), i -> struct(array_join(slice({words}, i + 1, {size}), ' ') as w, i as i)))")
    df = df.withColumn(windows, F.when(F.col(again), window))
    s = windows
    twice = F.expr(
        f"array_sort(transform(filter(sequence(0, size({s}) - 1), k -> coalesce(get({s}, k).w = get({s}, k - 1).w, false) or coalesce(get({s}, k).w = get({s}, k + 1).w, false)), k -> get({s}, k).i))"
    )
    df = df.withColumn(places, F.when(F.col(again), twice))
    covered = F.expr(f"aggregate(sequence(1, size({places}) - 1), {size}, (a, k) -> a + least({size}, {places}[k] - {places}[k - 1]))")
    return df.withColumn(out, F.when(F.col(again) & (F.size(places) > 1), covered).otherwise(0).cast("long")).drop(h, again, windows, places)


def base_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_marks (``!``), all long.

    Through the generator they are values, so whoever counts or filters by them many times has them computed once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = with_words(docs.select(F.struct(*keep).alias("kept"), text.alias("text")))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_CLASS)))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    df = with_repeat_words(df)
    found = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        removed_count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
    )
    return df.select("kept", F.explode(F.array(found)).alias("found")).select("kept.*", "found.*")
