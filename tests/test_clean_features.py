"""Cleaning, features, text and splits on literal frames (FIXTURES.md) and brute-force checks."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabflow.functions.exprs import parse_numeric_or_range
from tabflow.operators import clean as C
from tabflow.operators import eda as E
from tabflow.operators import features as FE
from tabflow.operators import split as S
from tabflow.operators.text import Tfidf


def test_numeric_text_converted(spark):
    df = spark.createDataFrame([(v,) for v in ["1000", "1200", "1500", "1800", "2000"]], "sqft string")
    out, conv = E.coerce_numeric_text(df)
    assert conv == ["sqft"]
    assert [r[0] for r in out.collect()] == [1000.0, 1200.0, 1500.0, 1800.0, 2000.0]


def test_range_text_midpoint(spark):
    df = spark.createDataFrame([(v,) for v in ["1000", "2100 - 2850", "1500", "1800 - 2000", "2000"]], "s string")
    got = [r[0] for r in df.select(parse_numeric_or_range("s")).collect()]
    assert got == [1000.0, 2475.0, 1500.0, 1900.0, 2000.0]


def test_true_category_not_converted(spark):
    df = spark.createDataFrame([(v,) for v in ["Paris", "Rome", "Oslo", "Lima", "Kyiv"]], "city string")
    _, conv = E.coerce_numeric_text(df)
    assert conv == []


def test_text_fill_empty_string(spark):
    df = spark.createDataFrame([("some text",), (None,), ("more",)], "t string")
    model = C.TableCleaner(text_cols=["t"], encode=False).fit(df)
    assert sorted(r[0] for r in model.transform(df).collect()) == ["", "more", "some text"]


def test_outlier_in_range_text(spark):
    vals = ["100", "110", "120", "105", "115", "108", "112", "118", "102", "9000 - 9200"]
    df, _ = E.coerce_numeric_text(spark.createDataFrame([(v,) for v in vals], "v string"))
    from tabflow.operators.quality import outlier_counts
    assert outlier_counts(df, ["v"]).first()["outlier_count"] == 1


def test_cleaner_fits_on_train_only(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, "b"), (5.0, "a")], "x double, c string")
    test = spark.createDataFrame([(None, "z"), (100.0, None)], "x double, c string")
    model = C.TableCleaner().fit(train)
    rows = model.transform(test).collect()
    assert rows[0]["x"] == 3.0  # train median, not test
    assert rows[0]["x_was_missing"] == 1
    assert model.state.one_hot["c"] == ["a", "b"]
    assert rows[0]["c_b"] == 0  # unseen level → all-zero dummies


def test_cleaner_save_load_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(float(i) if i % 4 else None, f"k{i % 20}") for i in range(60)], "x double, c string")
    model = C.TableCleaner().fit(df)
    model.save(spark, str(tmp_path / "m"))
    again = C.TableCleanerModel.load(spark, str(tmp_path / "m"))
    a = sorted(map(tuple, model.transform(df).collect()))
    b = sorted(map(tuple, again.transform(df).collect()))
    assert a == b and "c" in model.state.label_cols


def test_chunked_ffill_matches_window(spark):
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.randrange(3), base + dt.timedelta(hours=rnd.randrange(2000)),
             None if rnd.random() < 0.4 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, e int, ts timestamp_ntz, v double")
    got = C.fill_forward_backward(df, ["v"], ["ts", "id"], ["e"], slice_rows=4)
    w = W.partitionBy("e").orderBy("ts", "id")
    ref = df.select("id", F.coalesce("v", F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)),
                                     F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing))).alias("v"))
    assert sorted(map(tuple, got.select("id", "v").collect())) == sorted(map(tuple, ref.collect()))


def test_lags_per_entity_drop_rows(spark):
    base = dt.date(2023, 1, 1)
    rows = [(s, base + dt.timedelta(days=d), float(d + 10 * k)) for k, s in enumerate(["a", "b", "c"])
            for d in range(60)]
    df = spark.createDataFrame(rows, "store string, ds date, sales double")
    out = FE.dropna_rows(FE.lag_rolling_features(df, "sales", "ds", "store"))
    counts = {r["store"]: r["count"] for r in out.groupBy("store").count().collect()}
    assert counts == {"a": 53, "b": 53, "c": 53}
    r = out.where((F.col("store") == "a") & (F.col("ds") == dt.date(2023, 1, 11))).first()
    assert r["sales_lag_1"] == 9.0 and r["sales_lag_7"] == 3.0 and r["sales_rolling_mean_7"] == 6.0


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = FE.PopulationScaler(["a", "b"]).fit(df).transform(df).collect()
    assert [r["a"] for r in out] == [-1.0, 1.0] and [r["b"] for r in out] == [0.0, 0.0]


def test_tfidf_unseen_tokens_ignored(spark):
    train = spark.createDataFrame([(1, "free winner offer"), (2, "regular account update")], "id int, t string")
    model = Tfidf("id", "t").fit(train)
    assert model.vocabulary.count() == 6
    test = spark.createDataFrame([(3, "unseen token free")], "id int, t string")
    w = model.transform(test).collect()
    assert [(r["term"], round(r["weight"], 6)) for r in w] == [("free", 1.0)]


def test_tfidf_empty_text_gives_empty_vocabulary(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "id int, t string")
    assert Tfidf("id", "t").fit(df).empty


def test_class_too_small_falls_back_to_random(spark):
    df = spark.createDataFrame([(i, 0 if i < 29 else 1) for i in range(30)], "id int, y int")
    r = S.stratify_feasible(df, "y").first()
    assert r["method"] == "random"
    assert S.split_random(df, ["id"]).count() == 30


def test_random_split_exact_sizes(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "id int")
    counts = {r["split"]: r["count"] for r in S.split_random(df, ["id"]).groupBy("split").count().collect()}
    assert counts == {"test": 21, "train": 80}


def test_kfold_blocks(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id int")
    sizes = sorted(r["count"] for r in S.kfold(df, ["id"], k=3).groupBy("fold").count().collect())
    assert sizes == [3, 3, 4]


def test_oversample_balances(spark):
    df = spark.createDataFrame([(i, 1 if i < 5 else 0) for i in range(40)], "id int, y int")
    out = S.oversample(df, "y", ["id"])
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 35, 1: 35}


def test_oversample_keeps_rows_and_counts_draws(spark):
    rows = [(i, None if i % 50 == 0 else "maj" if i % 10 else "min") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y string")
    out = S.oversample(df, "y", ["id"]).collect()
    assert sorted((r["id"], r["y"]) for r in out if r["draw"] is None) == sorted(rows)
    extra = [r for r in out if r["draw"] is not None]
    n = {c: sum(y == c for _, y in rows) for c in ("maj", "min")}
    assert sorted(r["draw"] for r in extra) == list(range(n["maj"] - n["min"])) and {r["y"] for r in extra} == {"min"}
    assert all(rows[r["id"]][1] == "min" for r in extra) and len({r["id"] for r in extra}) == n["min"]
