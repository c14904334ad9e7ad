"""Term weights and embedding arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions.text import process_text, word_runs
from talkframe.operators import sequence as seq


def terms(text: Column, n: int = 2) -> Column:
    """Lower-case words of two or more characters and their ``n``-grams up to 2."""
    tokens = F.filter(word_runs(F.lower(process_text(text))), lambda w: F.length(w) >= 2)
    return tokens if n < 2 else with_pairs(tokens)


def with_pairs(tokens: Column) -> Column:
    """Tokens, then neighbours joined by a space. The list is bound once: written out, its splitting would run anew at each mention."""
    def both(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.concat(t, F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat_ws(" ", a, b)))

    return F.get(F.transform(F.array(tokens), both), F.lit(0))


def term_counts(df: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(id, term, tf). Words are split first and counted map-side."""
    tokens = df.select(ident, F.filter(word_runs(F.lower(process_text(F.col(text)))), lambda w: F.length(w) >= 2).alias("_t"))
    return tokens.select(ident, F.explode(with_pairs(F.col("_t"))).alias("term")).groupBy(ident, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 2, max_features: int = 12000) -> DataFrame:
    """(term, df, idf, term_id): terms in at least ``min_df`` documents, the most frequent ``max_features`` of them.

    idf is smoothed: ln((1 + n) / (1 + df)) + 1.
    """
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    kept = stats.orderBy(F.col("total").desc(), "term").limit(max_features)
    ids = Window.partitionBy().orderBy("term")  # at most max_features rows
    return kept.select(
        "term", "df", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"),
        (F.row_number().over(ids) - 1).alias("term_id"),
    )


def tfidf(counts: DataFrame, vocab: DataFrame, ident: str) -> DataFrame:
    """(id, term, term_id, weight) with 1 + ln(tf), idf and unit length per document."""
    raw = counts.join(vocab, "term").withColumn("_w", (F.log("tf") + 1.0) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(ident)))  # a document has at most max_features terms
    return raw.select(ident, "term", "term_id", "df", (F.col("_w") / norm).alias("weight"))


def unit(vector: Column) -> Column:
    """L2-normalised array of numbers."""
    v = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(length, F.lit(1e-12)))


def softmax(vector: Column) -> Column:
    top = F.array_max(vector)
    e = F.transform(vector, lambda x: F.exp(x.cast("double") - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def mean_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean of each dimension per group, as (keys, dim, value)."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "_x")).groupBy(*keys, "dim").agg(F.avg(F.col("_x").cast("double")).alias("value"))
