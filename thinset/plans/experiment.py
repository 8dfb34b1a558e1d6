"""Whole runs: hold out, downsample, train, evaluate; and sweeps of such runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import holdout_split
from ..workspace import save, spread
from .downsample import downsample
from .model import evaluate_classifier, train_classifier

SEED = 42
SWEEP_SCHEMA = (
    "dataset string, method string, k int, repeat int, seed int, "
    "acc double, precision double, recall double, f1 double"
)


def size_grid(n: int, steps: int = 11, smallest: int = 100) -> list[int]:
    """Evenly spaced sample sizes from ``smallest`` to ``n``, halves to even."""
    return [int(k) for k in np.round(np.linspace(smallest, n, steps))]


def run_experiment(
    train: DataFrame, test: DataFrame | None = None, method: str = "none", k: int | None = None,
    seed: int = SEED, text_col: str = "sentence", label_col: str = "label",
    id_col: str = "row_id", epochs: int = 3, stratify: bool = False,
    evaluate_during_training: bool = True, trainer: Callable = train_classifier, **extras,
):
    """Train on a subset and report on the test (or a held-out) table.

    Only the training part is downsampled.  Without a test table a tenth of the
    rows is held out first, if the table has more than ten.  Returns the model and
    its report, or ``None`` for the report if there is nothing to test on.
    """
    if test is None and evaluate_during_training:
        train, test = holdout_split(
            train, 0.1, seed, id_col, label_col if stratify else None
        )
    subset = downsample(train, method, k, seed, label_col, id_col, **extras)
    # Fitting passes over the subset several times; the source is read once.
    subset = spread(save(subset.select(text_col, label_col)))
    model = trainer(subset, text_col=text_col, label_col=label_col, epochs=epochs)
    if test is None:
        return model, None
    return model, evaluate_classifier(model, test, text_col, label_col)


def summary(report: DataFrame) -> dict:
    """Accuracy and macro averages of a report."""
    rows = {
        row["class"]: row
        for row in report.filter(F.col("class").isin("accuracy", "macro avg")).collect()
    }
    mean = rows["macro avg"]
    return {"acc": rows["accuracy"]["precision"], "precision": mean["precision"],
            "recall": mean["recall"], "f1": mean["f1"]}


def sweep(
    train: DataFrame, test: DataFrame, methods: Iterable[str], sizes: Iterable[int],
    repeats: int = 1, dataset: str = "data", skip_full: bool = False, epochs: int = 3,
    text_col: str = "sentence", label_col: str = "label", id_col: str = "row_id",
    trainer: Callable = train_classifier, options: dict[str, dict] | None = None,
) -> DataFrame:
    """Result rows of all methods x sizes x repeats; seeds are 42, 84, 126, ...

    ``options`` holds extra sampler arguments per method.  ``skip_full`` leaves
    out sizes that are the whole table.  Inputs are kept in memory or on disk
    for the whole sweep, only metrics come to the driver.
    """
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    test = test.persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        n = train.count()
        for k in sizes:
            if skip_full and k == n:
                continue
            for method in methods:
                for repeat in range(repeats):
                    seed = SEED * (repeat + 1)
                    _, report = run_experiment(
                        train, test, method, k, seed, text_col, label_col, id_col, epochs,
                        trainer=trainer, **(options or {}).get(method, {}),
                    )
                    found = summary(report)
                    rows.append((dataset, method, int(k), repeat, seed, *found.values()))
    finally:
        train.unpersist()
        test.unpersist()
    return train.sparkSession.createDataFrame(rows, SWEEP_SCHEMA)


def full_baseline(train: DataFrame, test: DataFrame, repeats: int = 3, **kwargs) -> DataFrame:
    """Repeats on the whole table, the line a sweep is compared with."""
    return sweep(train, test, ["none"], [train.count()], repeats, **kwargs)
