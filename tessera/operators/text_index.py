"""Lexical search: postings, corpus statistics and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings
from tessera.functions import strings


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, len): how often each document has each term, and its length in terms."""
    split = docs.select(F.col(key), strings.words(F.coalesce(F.col(text), F.lit(""))).alias("w")).withColumn("len", F.size("w"))
    return split.select(key, "len", F.explode("w").alias("term")).groupBy(key, "term", "len").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame, text: str) -> DataFrame:
    """(n_docs, avg_len), one row."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(strings.words(F.coalesce(F.col(text), F.lit(""))))).alias("avg_len"))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """(key, score) of the documents, a row each, with any of the terms; see bm25_fields()."""
    return bm25_fields(docs, key, {text: terms}, settings).select(key, F.col(f"score_{text}").alias("score"))


def bm25_fields(docs: DataFrame, key: str, fields: dict[str, list[str]], settings: Settings = DEFAULT) -> DataFrame:
    """(key, score_FIELD ...) of the documents, a row each, with any of the terms of any field.

    idf = ln(1 + (N - n + 0.5) / (n + 0.5)); score = sum of idf tf (k1 + 1) / (tf + k1 (1 - b + b len / avg len)).
    Terms are counted where documents are read, all fields in one pass. One aggregate gives N, the average lengths and
    every n; its row is broadcast, so documents are never shuffled.
    """
    asked = {f: sorted(set(terms)) for f, terms in fields.items()}
    if not any(asked.values()):
        return docs.select(F.col(key), *[F.lit(0.0).alias(f"score_{f}") for f in fields]).limit(0)
    said = lambda f: F.coalesce(F.col(f), F.lit(""))
    names = [(f, t, f"tf_{k}_{i}") for k, (f, terms) in enumerate(asked.items()) for i, t in enumerate(terms)]

    def counted(rows: DataFrame) -> DataFrame:
        split = rows.select(F.col(key), *[strings.words(said(f)).alias(f"w_{f}") for f in asked])
        return split.select(key, *[F.size(f"w_{f}").alias(f"len_{f}") for f in asked], *[_count_of(f"w_{f}", t).alias(n) for f, t, n in names])

    lengths = [F.avg(f"len_{f}").alias(f"avg_{f}") for f in asked]
    totals = counted(docs).agg(F.count("*").alias("n_docs"), *lengths, *[F.count_if(F.col(n) > 0).alias(f"df_{n}") for _, _, n in names])
    k1, b = settings.bm25_k1, settings.bm25_b

    def score(field: str) -> Column:
        total = F.lit(0.0)
        for f, _, n in names:
            if f == field:
                idf = F.log(1 + (F.col("n_docs") - F.col(f"df_{n}") + 0.5) / (F.col(f"df_{n}") + 0.5))
                total = total + idf * (F.col(n) * (k1 + 1) / (F.col(n) + k1 * (1 - b + b * F.col(f"len_{f}") / F.col(f"avg_{f}"))))
        return total.alias(f"score_{field}")

    # Texts without any term as a substring are dropped unsplit. A filter on the counts would be pushed below them and
    # split each text again for every term; the score is above 0 where a count is.
    might = F.lit(False)
    for f, t, _ in names:
        might = might | F.contains(F.lower(said(f)), F.lit(t))
    scored = counted(docs.where(might)).join(F.broadcast(totals)).select(key, *[score(f) for f in asked])
    return scored.where(F.greatest(F.lit(0.0), *[F.col(f"score_{f}") for f in asked]) > 0)


def _count_of(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))
