"""TF-IDF retrieval: which techniques does a text speak of?

Terms are counted inside the row of their text: the tokens are sorted and the ends of the runs give the counts. So a
text is neither exploded token by token nor shuffled before its terms have met the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.pin import pin
from .bloom import bloom_filter, might_hold, words_for

SCORE_DIGITS_FOR_TIES = 9
#: Pairs of a query and a document that one task may sum up at once, and the most tasks they are dealt to.
PAIRS_PER_TASK = 1 << 19
MOST_TASKS = 20_000


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text in order, stop words left out."""
    words = F.transform(F.regexp_extract_all(text, F.lit(V.TOKEN_PATTERN), F.lit(0)), F.lower)
    return F.filter(words, lambda w: ~w.isin(*V.STOP_WORDS))


def with_terms(docs: DataFrame, text: Column, out: str = "terms") -> DataFrame:
    """Add the distinct terms of a text with their counts and the largest count, as one struct column."""
    own = docs.columns
    words = pin(docs.withColumn("_text", text), "_t", F.sort_array(tokens(F.coalesce("_text", F.lit("")))))
    size = F.size("_t")
    ends = F.filter(
        F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")),
        lambda i: (i == F.size("_t")) | (F.get(F.col("_t"), i) != F.get(F.col("_t"), i - 1)),
    )
    runs = pin(words.drop("_text"), "_ends", ends)

    def run(end: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(F.col("_ends"), i - 1))
        return F.struct(F.get(F.col("_t"), end - 1).alias("term"), (end - start).alias("n"))

    counts = pin(runs, "_c", F.transform("_ends", run))
    return counts.select(*own, F.struct(F.col("_c").alias("counts"), F.array_max("_c.n").alias("max_n")).alias(out))


def exploded_terms(docs: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """``(key, term, n, max_n)`` from the column of :func:`with_terms`."""
    listed = docs.select(key, F.col(f"{terms}.max_n").alias("max_n"), F.explode(f"{terms}.counts").alias("c"))
    return listed.select(key, "c.term", "c.n", "max_n")


def term_counts(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, term, n, max_n)``: occurrences of each term and of the most frequent term of the text."""
    return exploded_terms(with_terms(docs.select(key, text.alias("_own")), F.col("_own")).select(key, "terms"), key)


def dealt(terms: DataFrame, pairs: int, index: DataFrame, key: str = "alert_id") -> DataFrame:
    """Queries with their terms, dealt out by key so that a task sums up a bounded number of pairs, whatever the input.

    ``pairs`` is the number of queries times that of documents. Terms that a Bloom filter of the index does not know
    stay behind. Where the index is broadcast, all up to the best documents of a query happens in the same task.
    """
    known = index.where(F.col("ord").isNull())
    words = words_for(known.count())
    rows = terms.withColumn("_known", bloom_filter(F.col("term"), known, words))
    met = F.struct(
        F.filter("terms.counts", lambda c: might_hold(F.col("_known"), c["term"], words)).alias("counts"),
        F.col("terms.max_n").alias("max_n"),
    )
    tasks = max(terms.sparkSession.sparkContext.defaultParallelism, min(-(-pairs // PAIRS_PER_TASK), MOST_TASKS))
    return rows.select(key, met.alias("terms")).repartition(tasks, key)


def augmented_tf() -> Column:
    """0.5 + 0.5 n / max n; the maximum is over all terms of the text, known to the corpus or not."""
    return F.lit(0.5) + F.lit(0.5) * F.col("n") / F.col("max_n")


def corpus_counts(corpus: DataFrame) -> DataFrame:
    return term_counts(corpus, "ord", F.concat_ws(" ", F.col("name"), F.col("text")))


def document_frequency(counts: DataFrame) -> DataFrame:
    """Number of documents per term, and the first of them; the counts hold one row per (document, term)."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.min("ord").alias("first_ord"))


def smoothed_idf(frequencies: DataFrame, corpus: DataFrame) -> DataFrame:
    """ln((1 + N) / (1 + df)) + 1 per term; N is a scalar subquery."""
    total = corpus.agg(F.count("*").alias("total")).scalar()
    idf = F.log((total + 1) / (F.col("df") + 1)) + 1.0
    return frequencies.select("term", idf.alias("idf"), "first_ord")


def corpus_vectors(corpus: DataFrame) -> DataFrame:
    """``(ord, term, idf, weight, first_ord)``: the unit-length TF-IDF vector of each document of the corpus."""
    counts = corpus_counts(corpus)
    idf = smoothed_idf(document_frequency(counts), corpus)
    weighted = counts.join(idf, "term").withColumn("w", augmented_tf() * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("ord")))
    return weighted.select("ord", "term", "idf", (F.col("w") / norm).alias("weight"), "first_ord")


def query_vectors(queries: DataFrame, idf: DataFrame, key: str = "alert_id", text: str = "text") -> DataFrame:
    """Unit-length vectors of the queries over the terms the corpus knows."""
    weighted = (
        term_counts(queries, key, F.col(text)).join(idf, "term").withColumn("w", augmented_tf() * F.col("idf"))
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / norm).alias("weight"))


def retrieval_index(corpus: DataFrame) -> DataFrame:
    """``(term, ord, idf, weight)``: postings of every term, and per term one more entry without ``ord``.

    The entry without ``ord`` lets the join that collects the dot products collect the squared norm of the query too.
    The first document of a term emits it.
    """
    posting = F.struct(F.col("ord"), F.col("weight"))
    for_norm = F.struct(F.lit(None).cast("int").alias("ord"), F.col("idf").alias("weight"))
    entries = F.when(F.col("ord") == F.col("first_ord"), F.array(posting, for_norm)).otherwise(F.array(posting))
    return corpus_vectors(corpus).select("term", "idf", F.explode(entries).alias("e")).select("term", "idf", "e.*")


def dot_products(counts: DataFrame, index: DataFrame, key: str = "alert_id") -> DataFrame:
    """``(key, ord, dot)``: dot products of each query with the documents that share a term with it.

    ``counts`` are the terms of the queries. The row without ``ord`` holds the squared norm of the query. If the queries
    are :func:`dealt` out by key, neither the pairs nor the sums are shuffled behind a broadcast index.
    """
    tf = augmented_tf()
    part = tf * F.col("idf") * F.col("weight") * F.when(F.col("ord").isNull(), tf).otherwise(1.0)
    met = counts.join(index, "term").select(key, "ord", part.alias("part"))
    return met.groupBy(key, "ord").agg(F.sum("part").alias("dot"))


def top_techniques(
    queries: DataFrame,
    corpus: DataFrame,
    top_k: int = V.TOP_K,
    min_score: float = 0.0,
    key: str = "alert_id",
    text: str = "text",
    index: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The ``top_k`` documents of the corpus per query with a score above ``min_score``; ties keep corpus order.

    Dot products that agree in ``SCORE_DIGITS_FOR_TIES`` digits are ties. ``counts`` may give the terms of the queries.
    """
    index = index if index is not None else retrieval_index(corpus)
    if counts is None:
        terms = with_terms(queries.select(key, F.col(text).alias("_own")), F.col("_own")).select(key, "terms")
        counts = exploded_terms(dealt(terms, queries.count() * corpus.count(), index, key), key)
    dots = dot_products(counts, index, key)
    # The norm row stands first; the group limit keeps it and the best k, and drops the rest before the shuffle.
    best = Window.partitionBy(key).orderBy(
        F.col("ord").isNotNull(), F.round("dot", SCORE_DIGITS_FOR_TIES).desc(), "ord"
    )
    per_query = Window.partitionBy(key)
    norm = F.sqrt(F.max(F.when(F.col("ord").isNull(), F.col("dot"))).over(per_query))
    return (
        dots.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top_k + 1)
        .withColumn("score", F.col("dot") / norm)
        .where(F.col("ord").isNotNull() & (F.col("score") > min_score))
        .select(key, "ord", "score", (F.col("rank") - 1).alias("rank"))
    )


def matched_techniques(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """Retrieved techniques with their name, tactic and text."""
    return ranked.join(corpus.select("ord", "id", "name", "tactic", F.col("text").alias("technique_text")), "ord")
