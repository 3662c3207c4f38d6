"""Registered queries for exact k nearest neighbours (M10) over ``embeddings``.

The reference rows are the 80 % hash-train part, the queries the rest. The oracles pair every
query with every reference row (fine for a check); the Spark side never does (see
``tabflow.operators.neighbors``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.functions.exprs import hash_unit
from tabflow.operators import neighbors as N
from tabflow.plans.common import sql_hash_unit
from tabflow.plans.registry import query, table

K = N.DEFAULT_K


def _emb_split(spark, sf):
    e = table(spark, sf, "embeddings")
    h = hash_unit("vec_id")
    return e.where(h < 0.8), e.where(h >= 0.8)


def _sql_pairs(vec: str, target: str | None = None) -> str:
    """Every (test, train) pair with the squared distance summed in coordinate order."""
    e_extra = f", {target} AS y" if target else ""
    d_extra = ", tr.y" if target else ""
    return f"""WITH e AS (SELECT vec_id, {vec} AS v, label{e_extra}, {sql_hash_unit('vec_id')} AS h FROM embeddings),
tr AS (SELECT * FROM e WHERE h < 0.8), te AS (SELECT * FROM e WHERE h >= 0.8),
d AS (SELECT te.vec_id, tr.vec_id AS neighbor_id, tr.label AS neighbor_label{d_extra},
  list_sum(list_transform(range(1, len(te.v) + 1), lambda i: (te.v[i] - tr.v[i]) * (te.v[i] - tr.v[i]))) AS d2
  FROM te, tr),
nb AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbor_id) AS INTEGER) AS rank
  FROM d QUALIFY rank <= {K})"""


def neighbours(spark, sf, vec, payload=("label",), k=K):
    tr, te = _emb_split(spark, sf)
    idx = N.build_index(tr, "vec_id", vec, payload=payload, k=k)
    return N.knn_search(idx, te, "vec_id", vec, k=k), te


@query("knn_exact", _sql_pairs("CAST(embedding AS DOUBLE[])") +
       " SELECT vec_id, rank, neighbor_id, round(sqrt(d2), 6) AS distance FROM nb")
def knn_exact(spark, sf):
    nb, _ = neighbours(spark, sf, F.col("embedding"))
    return nb.select(F.col("qid").alias("vec_id"), "rank", F.col("rid").alias("neighbor_id"),
                     F.round("distance", 6).alias("distance"))


@query("clf_knn", _sql_pairs("CAST(embedding AS DOUBLE[])") + f""",
votes AS (SELECT vec_id, neighbor_label, count(*) AS n FROM nb GROUP BY 1, 2),
pick AS (SELECT vec_id, neighbor_label AS prediction, n FROM votes
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, neighbor_label) = 1)
SELECT te.vec_id, te.label, pick.prediction, n / {K}.0::DOUBLE AS confidence FROM te JOIN pick USING (vec_id)""")
def clf_knn(spark, sf):
    nb, te = neighbours(spark, sf, F.col("embedding"))
    vote = N.knn_vote(nb, "label")
    return (te.select("vec_id", "label").join(vote.withColumnRenamed("qid", "vec_id"), "vec_id")
            .select("vec_id", "label", "prediction", "confidence"))


@query("reg_knn", _sql_pairs("CAST(embedding[2:] AS DOUBLE[])", "CAST(embedding[1] AS DOUBLE)") + """
SELECT te.vec_id, te.y, round(avg(nb.y), 6) AS prediction FROM te JOIN nb USING (vec_id) GROUP BY te.vec_id, te.y""")
def reg_knn(spark, sf):
    """Regression: the first coordinate predicted from the other 63 by the mean of 5 neighbours."""
    rest = F.slice("embedding", 2, F.size("embedding") - 1)
    tr, te = _emb_split(spark, sf)
    tr = tr.withColumn("y", F.col("embedding")[0].cast("double"))
    te = te.withColumn("y", F.col("embedding")[0].cast("double"))
    idx = N.build_index(tr, "vec_id", rest, payload=("y",))
    nb = N.knn_search(idx, te, "vec_id", rest)
    pred = N.knn_mean(nb, "y").withColumnRenamed("qid", "vec_id")
    return te.select("vec_id", "y").join(pred, "vec_id").select("vec_id", "y",
                                                                F.round("prediction", 6).alias("prediction"))
