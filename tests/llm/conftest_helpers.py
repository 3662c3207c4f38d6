"""Small frames and comparisons shared by the tests of the corpus operators."""

import os

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False, ids=None):
    """A documents frame of ``texts``; ``extra`` adds columns whose names clash with internal ones."""
    rows = [(i if ids is None else ids[i], t, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F
        for name in ("n", "r", "key", "h", "pos", "cls", "tok", "root", "bucket", "halo", "did", "no", "line", "place", "start", "piece",
                     "score", "lang_pred", "level0", "epoch", "taken", "tie", "v", "id", "a.b", "Text2", "lines_dropped",
                     "__row", "__again", "__did", "__th", "__at", "__least", "__line_drop", "_mix_id", "row", "th"):
            df = df.withColumn(name, F.lit(1))
    return df


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))


def duck(sql, sf_dir, tables=("documents", "pages", "embeddings", "labels")):
    import duckdb
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def same_as_sql(df, sql, sf_dir):
    names, want = duck(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    pick = [names.index(n) for n in order]
    key = lambda t: tuple((x is None, str(x)) for x in t)
    got = sorted((tuple(r[n] for n in order) for r in df.collect()), key=key)
    assert got == sorted((tuple(r[i] for i in pick) for r in want), key=key)
