"""Text columns: lengths, words and n-grams over whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.running import running_totals
from colscope.functions.staging import staged

# A word, and the words left out.
WORD = r"(?U)\b[a-z]{3,}\b"
STOPWORDS = [
    "the", "a", "an", "is", "in", "it", "of", "and", "to", "was", "for",
    "on", "are", "as", "at", "be", "by", "from", "or", "that", "this",
    "with", "but", "not", "have", "had", "he", "she", "they", "we", "you",
    "i", "my", "our", "his", "her", "its", "their", "will", "would", "can",
    "could", "do", "did", "does", "been", "has", "so", "if", "then",
    "than", "what", "which", "who", "how", "when", "where", "all", "each",
    "more", "also", "after", "before", "into", "up", "out", "about", "over",
]
TOP_WORDS = 20
TOP_NGRAMS = 15


def _matches(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def words(c: Column) -> Column:
    """Array of the words of a text, in order, without the left-out ones."""
    return F.filter(_matches(c), lambda w: ~w.isin(STOPWORDS))


def text_lengths(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, avg_length, max_length, min_length)."""
    rows = []
    for n in names:
        size = F.length(C.col(n))
        rows.append(F.struct(F.lit(n).alias("column"), C.round_to(F.avg(size), 1).alias("avg_length"),
                             F.max(size).cast("long").alias("max_length"), F.min(size).cast("long").alias("min_length")))
    return C.tidy(df, rows).filter("max_length IS NOT NULL")


def word_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n): every word with its count."""
    parts = [
        df.select(F.lit(n).alias("column"), F.explode(_matches(C.col(n))).alias("value"))
        .filter(~F.col("value").isin(STOPWORDS)).groupBy("column", "value").agg(F.count("*").alias("n"))
        for n in names
    ]
    return reduce(DataFrame.unionAll, parts)


def word_totals(counts: DataFrame) -> DataFrame:
    """(column, total_words, vocabulary_size) from the word counts."""
    return counts.groupBy("column").agg(F.sum("n").alias("total_words"), F.count("*").alias("vocabulary_size"))


def _grams(w: Column, n: int) -> Column:
    """Array of the runs of n neighbouring entries; empty when there are fewer."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))),
                        lambda i: F.concat_ws(" ", *[F.get(w, i + (k - 1)) for k in range(n)]))
    return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngram_counts(df: DataFrame, names: list[str], n: int, across_rows: str | None = None) -> DataFrame:
    """(column, value, n): runs of n neighbouring words with their count.

    Runs stay within a row, as rows have no order of their own. With `across_rows`, a number column
    that orders the rows, runs over the borders of rows are added.
    """
    parts = []
    for name in names:
        if across_rows and n > 1:
            counts = _counts_across(df.select(words(C.col(name)).alias("w"), C.col(across_rows).alias("k")), n)
        else:
            grams = df.select(words(C.col(name)).alias("w")).select(F.explode(_grams(F.col("w"), n)).alias("value"))
            counts = grams.groupBy("value").agg(F.count("*").alias("n"))
        parts.append(counts.select(F.lit(name).alias("column"), "value", "n"))
    return reduce(DataFrame.unionAll, parts)


def _counts_across(w: DataFrame, n: int) -> DataFrame:
    """(value, n): runs within rows and over their borders. Texts are gone over once: beside its runs, which are counted where they
    arise, a row gives one entry without value, with the words at its two ends, all that runs over borders need."""
    m = n - 1
    edge = F.when(F.size("w") <= 2 * m, F.col("w")).otherwise(F.concat(F.slice("w", 1, m), F.slice("w", -m, m)))
    ends = F.struct("k", F.size("w").alias("size"), edge.alias("edge"))
    none = F.lit(None).cast("string")
    entries = w.select(ends.alias("ends"), F.explode(F.concat(_grams(F.col("w"), n), F.array(none))).alias("value"))
    counted = staged(entries.groupBy("value", F.when(F.col("value").isNull(), F.col("ends")).alias("ends")).agg(F.count("*").alias("n")))
    rows = counted.filter("value IS NULL").select("ends.*", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    within = counted.filter("value IS NOT NULL").select("value", "n")
    return within.unionAll(_border_grams(rows, n).withColumn("n", F.lit(1))).groupBy("value").agg(F.sum("n").alias("n"))


def _border_grams(rows: DataFrame, n: int) -> DataFrame:
    """Runs of n words that begin in one row and end in a later one, of rows (k, size, edge).

    A run that begins at a word reaches at most n - 1 words on, so only the last n - 1 words of a row
    begin such runs, and only words numbered up to n - 1 later complete them: words are numbered over
    all rows by running totals of the row lengths, and joined by number. `edge` has the first and the
    last n - 1 words of a row, or all where there are no more.
    """
    sized = rows.filter("size > 0")
    per_key = sized.groupBy("k").agg(F.sum("size").alias("total"))
    starts = running_totals(per_key, "k", {"start": "total"}).select("k", "start")
    ends = sized.join(starts, "k").select("start", "size", F.size("edge").alias("held"), F.posexplode("edge").alias("p", "word"))
    ends = ends.withColumn("i", F.when(F.col("p") < n - 1, F.col("p")).otherwise(F.col("size") - F.col("held") + F.col("p")))
    numbered = ends.select((F.col("start") + F.col("i")).alias("at"), (F.col("size") - F.col("i")).alias("left"), "word")
    firsts = numbered.filter(F.col("left") < n)
    reach = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step")
    wanted = firsts.select("at", reach).withColumn("word_at", F.col("at") + F.col("step"))
    found = wanted.join(numbered.select(F.col("at").alias("word_at"), "word"), "word_at")
    runs = found.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("step", "word"))).alias("run"))  # at most n words
    return runs.filter(F.size("run") == n).select(
        F.concat_ws(" ", F.transform("run", lambda x: x["word"])).alias("value"))


def top_terms(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent terms per column, by count and then alphabetically."""
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def text_analysis(df: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """The summary per column and the top words, bigrams and trigrams."""
    counts = word_counts(df, names)
    return {
        "summary": text_lengths(df, names).join(word_totals(counts), "column", "left")
        .fillna(0, ["total_words", "vocabulary_size"]),
        "words": top_terms(counts, TOP_WORDS),
        "bigrams": top_terms(ngram_counts(df, names, 2), TOP_NGRAMS),
        "trigrams": top_terms(ngram_counts(df, names, 3), TOP_NGRAMS),
    }
