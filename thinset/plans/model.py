"""Embedding, training and prediction as Spark jobs.

The default models are Spark ML pipelines.  Any other model plugs in as a
factory that Spark calls once per Python worker and feeds with Arrow batches
(``predict_batch_udf``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    IDF, HashingTF, IndexToString, Normalizer, RegexTokenizer, StringIndexer,
)
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text
from ..workspace import new_path
from ..operators.metrics import (
    accuracy, binary_f1, classification_report, entity_scores, evaluate,
)

BATCH = 32


def _text_stages(text_col: str, features: int, output: str) -> list:
    return [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol=output),
    ]


def embed(
    df: DataFrame, text_col: str = "sentence", embedder: Callable | None = None,
    vec_col: str = "embedding", features: int = 256, batch_size: int = BATCH,
) -> DataFrame:
    """Add a vector per text.

    ``embedder`` is a factory: it returns a function from an array of texts to a
    matrix.  Without one, hashed TF-IDF vectors of unit length are used.
    """
    if embedder is not None:
        vectors = predict_batch_udf(
            embedder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
        )
        return df.withColumn(vec_col, vectors(F.col(text_col)))
    stages = [*_text_stages(text_col, features, "_idf"),
              Normalizer(inputCol="_idf", outputCol="_unit")]
    fitted = Pipeline(stages=stages).fit(df.select(text_col))
    return (
        fitted.transform(df)
        .withColumn(vec_col, vector_to_array("_unit", "float32"))
        .select(*df.columns, vec_col)
    )


def train_classifier(
    train: DataFrame, text_col: str = "sentence", label_col: str = "label", epochs: int = 3,
    features: int = 1 << 12, regularization: float = 0.01, path: str | None = None,
) -> PipelineModel:
    """Text classifier (hashed TF-IDF and logistic regression); ``epochs`` counts
    the optimizer's passes over the data.  Predictions carry the original labels
    as strings.  ``path`` also stores the whole model."""
    # Alphabetical order makes the indexes independent of class frequencies.
    indexer = StringIndexer(
        inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc"
    )
    names = indexer.fit(train.select(label_col))
    stages = [
        *_text_stages(text_col, features, "_features"),
        LogisticRegression(
            featuresCol="_features", labelCol="_label", maxIter=epochs, regParam=regularization,
            predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw",
        ),
        IndexToString(inputCol="_prediction", outputCol="prediction", labels=names.labels),
    ]
    # The label index is needed for fitting only, so the model can score unlabelled text.
    fitted = Pipeline(stages=stages).fit(names.transform(train.select(text_col, label_col)))
    # A stored and reloaded regression leaves its training summary behind, which
    # holds on to the training data and cannot be sent to executors.
    kept = new_path(train.sparkSession, "model")
    fitted.stages[-2].write().save(kept)
    model = PipelineModel(
        [*fitted.stages[:-2], LogisticRegressionModel.load(kept), fitted.stages[-1]]
    )
    if path:
        model.write().overwrite().save(path)
    return model


def predict(
    model: PipelineModel | str, df: DataFrame, text_col: str = "text",
    output_col: str = "predicted_label",
) -> DataFrame:
    """Input rows that have a text, with their predicted label; one narrow pass."""
    if isinstance(model, str):
        model = PipelineModel.load(model)
    trained_on = model.stages[0].getInputCol()
    texts = clean_text(df, text_col)
    scored = texts if text_col == trained_on else texts.withColumn(trained_on, F.col(text_col))
    return model.transform(scored).select(
        *[F.col(c) for c in df.columns], F.col("prediction").alias(output_col)
    )


def predict_with(
    make_model: Callable, df: DataFrame, text_col: str = "text",
    output_col: str = "predicted_label", batch_size: int = BATCH, return_type=None,
) -> DataFrame:
    """As :func:`predict` for a model Spark does not know: ``make_model`` returns a
    function from an array of texts to an array of labels."""
    label = predict_batch_udf(
        make_model, return_type=return_type or T.LongType(), batch_size=batch_size
    )
    return clean_text(df, text_col).withColumn(output_col, label(F.col(text_col)))


def evaluate_classifier(
    model: PipelineModel, test: DataFrame, text_col: str = "sentence", label_col: str = "label",
    metrics: dict | None = None,
) -> DataFrame:
    """Classification report of ``model`` on ``test``, or named metrics of it."""
    scored = predict(model, test, text_col, "prediction").select(label_col, "prediction")
    if metrics is not None:
        return evaluate(scored, metrics, label_col, "prediction")
    return classification_report(scored, label_col, "prediction")


DEFAULT_METRICS = {"acc": accuracy, "f1": binary_f1}


def evaluate_tags(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Span scores of predicted BIO tags."""
    return entity_scores(gold, predicted)
