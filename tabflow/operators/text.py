"""TF-IDF text features (F09–F10), fitted on training rows only.

Fit: the tokens of a row are sorted, so that its first occurrence of a term is known in the row; one map-side combined
``groupBy(term)`` then gives corpus counts and document frequencies, and the top k by corpus count (a distributed
``TakeOrderedAndProject``) get a smooth idf. Apply: the vocabulary (at most ``max_features`` terms) is part of the model, and
counting, weighting and the L2 norm happen inside the row; nothing is exchanged.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabflow.functions.exprs import col_

# Two or more letters/digits/underscore, lower-cased (default TF-IDF tokens).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
MAX_FEATURES = 100


def tokens(text_col: str):
    """The lower-cased tokens of a text (none for NULL)."""
    found = F.regexp_extract_all(F.lower(col_(text_col).cast("string")), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


class TfidfModel:
    def __init__(self, vocabulary: DataFrame, n_docs: int, id_col: str, text_col: str):
        self.vocabulary, self.n_docs, self.id_col, self.text_col = vocabulary, n_docs, id_col, text_col
        terms = vocabulary.orderBy("index").collect()  # at most max_features rows
        self.terms, self.idf = [r["term"] for r in terms], [r["idf"] for r in terms]

    @property
    def empty(self) -> bool:
        return not self.terms

    def _weighted(self, df: DataFrame) -> DataFrame:
        """(id, w): per row the normalised weights of all terms, in the vocabulary's order."""
        counter = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_tokens", outputCol="_counts")
        rows = counter.transform(df.select(col_(self.id_col).alias("_id"), tokens(self.text_col).alias("_tokens")))
        raw = F.zip_with(vector_to_array("_counts"), F.array(*[F.lit(x) for x in self.idf]), lambda tf, idf: tf * idf)
        rows = rows.select("_id", raw.alias("_raw"))
        square = F.aggregate("_raw", F.lit(0.0), lambda acc, x: acc + x * x)
        rows = rows.select("_id", "_raw", F.sqrt(square).alias("_norm"))
        return rows.select(F.col("_id").alias(self.id_col), F.when(F.col("_norm") > 0, F.transform("_raw", lambda x: x / F.col("_norm")))
                           .otherwise(F.col("_raw")).alias("w"))

    def transform(self, df: DataFrame) -> DataFrame:
        """``(id, term, weight)``: tf·idf, L2-normalised per row; unseen terms ignored, rows that share an id stay apart."""
        if self.empty:
            return df.select(col_(self.id_col), F.lit("").alias("term"), F.lit(0.0).alias("weight")).where(F.lit(False))
        pairs = F.arrays_zip(F.array(*[F.lit(t) for t in self.terms]).alias("term"), F.col("w").alias("weight"))
        out = self._weighted(df).select(col_(self.id_col), F.inline(F.filter(pairs, lambda x: x["weight"] > 0)))
        return out.toDF(self.id_col, "term", "weight")

    def to_vectors(self, df: DataFrame, out_col: str = "tfidf") -> DataFrame:
        """MLlib vectors in the vocabulary's order, one per row (without a known term: the zero vector)."""
        if self.empty:
            return df.select(col_(self.id_col), array_to_vector(F.array().cast("array<double>")).alias(out_col))
        return self._weighted(df).select(col_(self.id_col), array_to_vector("w").alias(out_col))


class Tfidf:
    """lower-case ≥2-character tokens, top-k terms by corpus count, idf = ln((1+n)/(1+df)) + 1."""

    def __init__(self, id_col: str, text_col: str, max_features: int = MAX_FEATURES):
        self.id_col, self.text_col, self.max_features = id_col, text_col, max_features

    def fit(self, df: DataFrame) -> TfidfModel:
        docs = df.where(col_(self.text_col).isNotNull())
        n = docs.count()
        each = docs.select(F.sort_array(tokens(self.text_col)).alias("t")).select("t", F.posexplode("t").alias("at", "term"))
        new = (F.col("at") == 0) | (F.col("t")[F.greatest(F.col("at") - 1, F.lit(0))] != F.col("term"))
        stats = each.select("term", new.cast("bigint").alias("new")).groupBy("term").agg(
            F.count(F.lit(1)).alias("corpus_count"), F.sum("new").alias("df"))
        top = stats.orderBy(F.desc("corpus_count"), F.asc("term")).limit(self.max_features)
        vocab = (top.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
                 .withColumn("index", (F.row_number().over(W.orderBy("term")) - 1).cast("int")))  # ≤ k rows
        return TfidfModel(vocab.cache(), n, self.id_col, self.text_col)


def smooth_idf(n: int, df: int) -> float:
    return math.log((1.0 + n) / (1.0 + df)) + 1.0
