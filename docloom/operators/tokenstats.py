"""Token, n-gram, collocation and TF-IDF statistics.

Documents come as (doc_id, path, text); ``path`` orders them where a rank has ties. Occurrences and records are counted
in one exchange: every document's array yields a row per occurrence and a row per distinct token, which the map side
adds up before anything moves. What only breaks ties is looked up for the ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docloom.functions.text import kept_tokens, tokens
from docloom.shared import cut, exploded, small_side


def with_tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, path, tokens``: the kept tokens of each text in order; none for null."""
    return docs.select("doc_id", "path", kept_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def _occurrences(arrays: DataFrame, array: str | Column, name: str) -> DataFrame:
    """``name, c, d`` rows whose sums are occurrences and records; both are numbers, so they are added up in a hash table."""
    a = F.col(array) if isinstance(array, str) else array
    each = F.transform(a, lambda t: F.struct(t.alias(name), F.lit(1).alias("c"), F.lit(0).alias("d")))
    once = F.transform(F.array_distinct(a), lambda t: F.struct(t.alias(name), F.lit(0).alias("c"), F.lit(1).alias("d")))
    return exploded(arrays, [], F.concat(each, once), "o").select("o.*")


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, count, document_count`` of all kept tokens."""
    rows = _occurrences(with_tokens(docs), "tokens", "token")
    return rows.groupBy("token").agg(F.sum("c").alias("count"), F.sum("d").alias("document_count"))


def top_by_count(counts: DataFrame, key: str, limit: int, rows: DataFrame) -> DataFrame:
    """The ``limit`` rows of ``counts`` with the highest ``count``; of those that tie for the last places the ones first
    seen in ``rows`` (key, path, pos).

    Where a term was first seen is looked up for the ties only, so the counting itself carries no position.
    """
    counts = cut(counts, "counts")
    last = counts.orderBy(F.desc("count")).limit(limit).agg(F.min("count"), F.count("*")).first()
    if last[1] < limit:
        return counts
    above = counts.filter(F.col("count") > last[0])
    tied = cut(counts.filter(F.col("count") == last[0]), "tied")
    places = limit - above.count()
    if tied.count() <= places:
        return above.unionByName(tied)
    seen = rows.join(small_side(tied.select(key)), key).groupBy(key).agg(F.min(F.struct("path", "pos")).alias("_first"))
    return above.unionByName(tied.join(seen, key).orderBy("_first").limit(places).drop("_first"))


def top_tokens(docs: DataFrame, limit: int = 5000) -> DataFrame:
    """``token, count, document_count`` of the most frequent tokens, ties for the last places by first seen."""
    rows = exploded(with_tokens(docs), ["path"], "tokens", "token", "pos")
    return top_by_count(token_counts(docs), "token", limit, rows).orderBy(F.desc("count"), "token")


def grams_of(array: str, n: int) -> Column:
    """n consecutive elements joined by blanks, one per start: the array zipped with itself, shifted, so that the work is
    linear in its length."""
    a = F.col(array)
    out = a
    for shift in range(1, n):
        later = F.slice(a, F.lit(shift + 1), F.greatest(F.size(a) - shift, F.lit(0)))
        out = F.zip_with(out, later, lambda x, y: F.concat(x, F.lit(" "), y))
    return F.filter(out, lambda g: g.isNotNull()) if n > 1 else out


def ngram_counts(docs: DataFrame, n: int) -> DataFrame:
    grams = exploded(with_tokens(docs), [], grams_of("tokens", n), "ngram")
    return grams.groupBy("ngram").agg(F.count("*").alias("count"))


def top_ngrams(docs: DataFrame, n: int, limit: int = 500) -> DataFrame:
    """``ngram, n, count`` of the most frequent n-grams of kept tokens, ties for the last places by first seen."""
    rows = exploded(with_tokens(docs), ["path"], grams_of("tokens", n), "ngram", "pos")
    return top_by_count(ngram_counts(docs, n), "ngram", limit, rows).select("ngram", F.lit(n).cast("long").alias("n"), "count")


def plain_ngrams(docs: DataFrame, stopwords, n: int) -> DataFrame:
    """``ngram, count`` over tokens that are no stop word and longer than two characters."""
    kept = F.filter(tokens(F.coalesce("text", F.lit(""))), lambda t: (F.length(t) > 2) & ~t.isin(*stopwords))
    return (
        exploded(docs.select(kept.alias("t")), [], grams_of("t", n), "ngram").groupBy("ngram")
        .agg(F.count("*").alias("count"))
    )


def collocations(docs: DataFrame, min_count: int = 5, limit: int = 500) -> DataFrame:
    """Bigrams of at least ``min_count`` by pointwise mutual information, log2(c12 * N / (c1 * c2)), N all kept tokens."""
    single = cut(token_counts(docs).select("token", "count"), "tokens")
    total = single.agg(F.sum("count").alias("total"))
    pairs = (
        ngram_counts(docs, 2).filter(F.col("count") >= min_count).select("ngram", F.col("count").alias("c12"))
        .withColumns({"a": F.split("ngram", " ")[0], "b": F.split("ngram", " ")[1]})
    )
    first = single.select(F.col("token").alias("a"), F.col("count").alias("c1"))
    second = single.select(F.col("token").alias("b"), F.col("count").alias("c2"))
    pmi = F.round(F.log2(F.col("c12") * F.col("total") / (F.col("c1") * F.col("c2"))), 6)
    return (
        pairs.join(first, "a").join(second, "b").join(F.broadcast(total))
        .select(F.col("ngram").alias("bigram"), F.col("c12").alias("count"), F.col("c1").alias("first_token_count"), F.col("c2").alias("second_token_count"), pmi.alias("pmi"))
        .orderBy(F.desc("pmi"), F.desc("count"), "bigram").limit(limit)
    )


def tfidf(docs: DataFrame, features: int = 5000, min_df: int = 2, max_df: float = 0.9) -> DataFrame:
    """``doc_id, term, tfidf``: raw term counts times ln((1 + N) / (1 + df)) + 1 over 1- and 2-grams, rows of length 1.

    Kept tokens are split at hyphens again. Terms of at least ``min_df`` and at most ``max_df`` * N records, of those the
    ``features`` most frequent (ties by term). Documents left without a term give no rows. Texts are taken apart once: they
    are placed by document first, so counting the terms of each moves nothing more; all else comes from these counts.
    """
    n = docs.count()
    words = F.regexp_extract_all(F.array_join(kept_tokens(F.coalesce("text", F.lit(""))), " "), F.lit(r"([^\s-]+)"), F.lit(1))
    terms = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", words.alias("w")).select("doc_id", F.concat("w", grams_of("w", 2)).alias("terms"))
    counted = cut(exploded(terms, ["doc_id"], "terms", "term").groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "counted")
    vocabulary = cut(
        counted.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
        .filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n)))
        .orderBy(F.desc("total"), "term").limit(features)
        .select("term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")),
        "vocabulary",
    )
    weighted = counted.join(F.broadcast(vocabulary), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("tfidf"))


def top_by_document(scores: DataFrame, top: int = 20) -> DataFrame:
    """``doc_id, rank, term, tfidf`` (8 digits), ties by term."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("tfidf", 8)), "term")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select(
        "doc_id", "rank", "term", F.round("tfidf", 8).alias("tfidf")
    )


def top_by_group(scores: DataFrame, docs: DataFrame, fields: tuple[str, ...], top: int = 25) -> DataFrame:
    """Mean scores per value of each field, over all documents of the group, those without terms as zero."""
    pairs = docs.select(
        "doc_id", F.explode(F.array(*(F.struct(F.lit(f).alias("group_field"), F.col(f).alias("group_value")) for f in fields))).alias("g")
    ).select("doc_id", "g.*")
    size = pairs.groupBy("group_field", "group_value").agg(F.count("*").alias("document_count"))
    means = (
        scores.join(pairs, "doc_id").groupBy("group_field", "group_value", "term").agg(F.sum("tfidf").alias("s"))
        .join(size, ["group_field", "group_value"])
        .select("group_field", "group_value", "term", F.round(F.col("s") / F.col("document_count"), 8).alias("mean_tfidf"), "document_count")
        .filter("mean_tfidf > 0")
    )
    order = Window.partitionBy("group_field", "group_value").orderBy(F.desc("mean_tfidf"), "term")
    return means.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
