import numpy as np
import pytest
from pyspark.sql import functions as F

from thinset.functions import arrays, text
from thinset.operators import metrics


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    gold = rng.integers(0, 4, 400)
    pred = np.where(rng.random(400) < 0.7, gold, rng.integers(0, 3, 400))
    pred[:3] = 9  # a class that is never gold
    rows = [(i, int(g), int(p)) for i, (g, p) in enumerate(zip(gold, pred))]
    return spark.createDataFrame(rows, "row_id long, label int, prediction int")


def test_report_identities(scored):
    rows = {r["class"]: r for r in metrics.classification_report(scored).collect()}
    classes = [r for name, r in rows.items() if name not in ("accuracy", "macro avg", "weighted avg")]
    assert len(classes) == 5 and rows["9"].recall == 0.0 and rows["9"].support == 0
    hits = scored.filter("label = prediction").count()
    assert rows["accuracy"].f1 == pytest.approx(hits / 400)
    assert rows["weighted avg"].recall == pytest.approx(rows["accuracy"].f1)
    for score in ("precision", "recall", "f1"):
        assert rows["macro avg"][score] == pytest.approx(np.mean([c[score] for c in classes]))
    assert rows["macro avg"].support == sum(c.support for c in classes) == 400


def test_named_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "label int, prediction int")
    found = {r.metric: r.value for r in metrics.evaluate(
        df, {"acc": metrics.accuracy, "f1": metrics.binary_f1}).collect()}
    assert found == {"acc": 0.6, "f1": pytest.approx(2 / 3)}
    none = metrics.evaluate(df.filter("label = 0 and prediction = 0"), {"f1": metrics.binary_f1})
    assert none.first().value == 0.0


def tokens(spark, *sentences):
    rows = [(s, i, tag) for s, tags in enumerate(sentences) for i, tag in enumerate(tags.split())]
    return spark.createDataFrame(rows, "sentence_id long, token_pos int, label string")


def test_spans(spark):
    df = tokens(spark, "B-a I-a O B-a B-a I-b I-b", "I-a I-a O I-a", "O O")
    got = {(r.sentence_id, r.start, r.end, r.type) for r in metrics.bio_spans(df).collect()}
    assert got == {(0, 0, 1, "a"), (0, 3, 3, "a"), (0, 4, 4, "a"), (0, 5, 6, "b"),
                   (1, 0, 1, "a"), (1, 3, 3, "a")}


def test_entity_scores(spark):
    gold = tokens(spark, "B-a I-a O B-b", "B-a O")
    pred = tokens(spark, "B-a I-a O B-a", "B-a I-a")
    row = metrics.entity_scores(gold, pred).first()
    assert (row.gold, row.predicted, row.matched) == (3, 3, 1)
    assert row.f1 == pytest.approx(1 / 3)
    empty = metrics.entity_scores(tokens(spark, "O"), tokens(spark, "O")).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0],), ([1000.0, 0.0, 0.0, 0.0],)], "x array<double>")
    rows = df.select(arrays.argmax("x").alias("a"), arrays.softmax("x").alias("s"),
                     arrays.sigmoid("x").alias("g"), arrays.cosine("x", F.array(*[F.lit(0.0)] * 4)).alias("z"))
    first, second = rows.collect()
    want = np.exp(np.array([1, 3, 3, -2]) - 3)
    assert first.a == 1 and first.s == pytest.approx(list(want / want.sum()))
    assert first.g[3] == pytest.approx(1 / (1 + np.exp(2))) and first.z == 0.0
    assert second.s[0] == pytest.approx(1.0)


def test_text(spark):
    df = spark.createDataFrame(
        [(" a  b\tc d ", "Saudi Arabian guards of Saudi Arabia", "Saudi Arabia", "")],
        "t string, s string, h string, e string")
    row = df.select(
        text.fields("t").alias("f"), text.fields(F.lit("  ")).alias("none"),
        text.mark_entities("s", "h", "e").alias("m"),
        text.span_text(F.split(F.lit("x y z"), " "), F.array(F.lit(2), F.lit(0))).alias("p"),
    ).first()
    assert row.f == ["a", "b", "c", "d"] and row.none == [] and row.p == "z x"
    assert row.m == "[Saudi Arabia HEAD ENTITY]n guards of [Saudi Arabia HEAD ENTITY]"
    with pytest.raises(Exception, match="out of range"):
        df.select(text.span_text(F.array(F.lit("x")), F.array(F.lit(3)))).collect()
