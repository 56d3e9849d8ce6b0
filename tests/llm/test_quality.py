import numpy as np
import pytest
from pyspark.sql import functions as F

from starmart.llm import quality, queries

from .conftest import SMALL


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = queries.op6_quality(spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.where("predicted <> int(score >= 0.7)").count() == 0
    held = got.where("held_out").join(labels, "doc_id")
    good, bad = held.where("quality = 1"), held.where("quality = 0")
    assert good.where("predicted = 1").count() >= 0.97 * good.count()
    assert bad.where("predicted = 0").count() >= 0.8 * bad.count()


def test_column_equals_matrix(spark, documents):
    """The compiled expression and the rules applied in numpy give the same scores."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(documents, labels)
    assert 0 < len(model.rules) and model.describe()
    rows = quality.with_features(documents, "text").withColumn("score", model.column()).toPandas()
    x = rows[[f"__f_{f}" for f in quality.FEATURES]].to_numpy()
    assert np.allclose(model.score(x), rows["score"])


def test_statistics(spark):
    text = "Ab cd ab.\nÉ 12!! x|y"
    row = spark.createDataFrame([(text,)], "t string").select(*[v.alias(k) for k, v in quality.statistics(F.col("t")).items()]).first().asDict()
    assert row == dict(chars=20, n_words=6, n_distinct=6, n_lines=2, n_letters=9, n_upper=2, n_digits=2, n_stops=2, n_pipes=1, n_symbols=1, n_bangs=1)


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = 1.0 - ((x[:, 2] > 0.7) & (x[:, 5] <= 0.4))
    model = quality.fit_rules(x, y)
    new = rng.random((1000, len(quality.FEATURES)))
    want = 1.0 - ((new[:, 2] > 0.7) & (new[:, 5] <= 0.4))
    assert ((model.score(new) >= 0.5) == want).mean() > 0.97
    assert len(model.rules) < 250


@pytest.mark.parametrize("y", [[], [1.0] * 30, [0.0] * 30])
def test_one_class(y):
    x = np.zeros((len(y), len(quality.FEATURES)))
    model = quality.fit_rules(x, np.array(y))
    assert model.rules == [] and 0 < model.score(np.zeros((1, len(quality.FEATURES))))[0] < 1


def test_nasty_rows(spark, nasty, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").union(spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    model = quality.fit(documents, labels)
    out = quality.classify(nasty, model)
    assert out.columns.count("score") == 1 and dict(out.dtypes)["score"] == "double" and out.count() == nasty.count()
    assert out.where("score is null or predicted is null").count() == 0
    assert quality.classify(nasty.limit(0), model).count() == 0
    assert quality.fit(nasty.limit(0), labels).rules == [] and quality.fit(documents, labels.limit(0)).rules == []
