"""Corpus pipeline: language ID, line dedup, near-duplicate documents, source mixing, packing.

Every stage is ``(name, function(spark, docs, sf_dir) -> DataFrame)``; its result is written as Parquet and read back
as the next stage's documents. All but the last return the columns of ``documents``. A stage works on everything that
its predecessor kept, and its decisions take effect:

* *language*: texts without a language (``und``), and texts of which no language has half the letters, go; ``lang``
  becomes the predicted one;
* *lines*: later copies and near copies of lines go, ``n_chars`` follows, and a document that loses all its text goes;
* *near duplicates*: of every component of documents linked at 0.75 one row stays, that with the smallest id; repeated
  rows are copies, rows that share an id but not the text are different documents, and rows without an id come last;
* *mixing*: the words of all documents twice are the budget, split to the weights of domains, languages and sources; a row
  is repeated as often as its source's epochs take it, at most four times, and rows without words go;
* *packing*: the places of all kept documents in sequences; a document has one place, and the sequence says how many
  epochs it is used (``epochs``), as all documents in it are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm import jaccard, langid, linededup, mixing, packing
from tabflow.llm.common import checked_broadcast, col, free_name, small_batches, told_apart, written

LEAST_SHARE = 0.5
#: Budget of the mix, in all words, and the most epochs of a source: enough to reach the weights without losing documents.
MIXED_WORDS, MIXED_EPOCHS = (2, 1), 4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    seen = langid.identify(docs, langid.learn(docs), carry=True)
    pred, score = seen.columns[len(docs.columns):]
    kept = seen.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SHARE))
    return kept.select(*(F.col(pred).alias(c) if c == "lang" else col(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = linededup.dedup_lines(docs)
    emptied = (F.col(out.columns[-1]) > 0) & (F.trim("text") == "")
    return out.where(~emptied).select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows, row, again = told_apart(docs, "doc_id", "text")
    found = jaccard.jaccard_components(rows.where(~F.col(again)).select(F.col(row).alias("row"), "text"), "row").where("doc_id <> component_id")
    found = checked_broadcast(written(found.select(F.col("doc_id").alias(row)).distinct(), "pipeline-copies"))
    # A repeated row is a copy if its text has words; texts without words link with nothing.
    copy = F.col(again) & F.coalesce(F.col("text").rlike("[^ \t-\r]"), F.lit(False))
    return rows.where(~copy).join(found, row, "left_anti").select(*(col(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domain = free_name("mix_domain", docs.columns)
    named = docs.withColumn(domain, mixing.domain_of(F.col("source")))
    weights = {domain: mixing.WEIGHTS["domain"], "lang": mixing.WEIGHTS["lang"]}
    return mixing.select_documents(named, [domain, "lang", "source"], weights, MIXED_WORDS, max_epochs=MIXED_EPOCHS).select(
        *(col(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n = packing.word_count(F.col("text")) + 1
    once = docs.groupBy("doc_id", n.alias("n"), F.xxhash64("text").alias("th"), F.col("text").isNull().alias("none"))
    once = written(once.agg(F.count(F.lit(1)).alias("epochs")).select("doc_id", "n", "epochs"), "pipeline-once")
    return packing.pack(once, length_col="n", epochs_col="epochs")


STAGES = [("language", language), ("lines", lines), ("near duplicates", near_duplicates), ("mixing", mixed), ("packing", packed)]

#: Language ID and best-fit packing have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
    return docs
