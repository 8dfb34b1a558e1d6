"""One entry point for all samplers, open for user-defined ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.coverage import sample_acs
from ..operators.sampling import (
    sample_groups, sample_random, sample_score, sample_selection, sample_stratified,
)
from ..sources.tables import read_ranking, read_selection

Sampler = Callable[..., DataFrame]


def _random(df, k, *, seed, id_col, **_):
    return sample_random(df, k, seed, id_col)


def _stratified(df, k, *, seed, label_col, id_col, **_):
    return sample_stratified(df, k, label_col, seed, id_col)


def _groups(df, k, *, seed, group_col="sentence_id", **_):
    return sample_groups(df, k, group_col, seed)


def _score(df, k, *, id_col, ranking=None, ranking_path=None, dataset="sst2",
           score_method="aum", **_):
    if ranking is None:
        if ranking_path is None:
            raise ValueError("score sampling needs a ranking or a ranking_path")
        ranking = read_ranking(df.sparkSession, f"{ranking_path}/{dataset}", score_method)
    return sample_score(df, k, ranking, id_col)


def _selection(df, k, *, id_col, selection_path, selection_method="acs", **_):
    stored = read_selection(df.sparkSession, selection_path, selection_method, k)
    return sample_selection(df, stored, id_col)


def _acs(df, k, *, label_col, id_col, embeddings=None, use_labels=True, seed=None, **search):
    return sample_acs(
        df, k, embeddings, label_col if use_labels else None, id_col=id_col, **search
    )


_SAMPLERS: dict[str, Sampler] = {
    "random": _random, "stratified": _stratified, "groups": _groups,
    "score": _score, "selection": _selection, "acs": _acs,
}


def register_sampler(name: str, sampler: Sampler) -> None:
    """Add or replace a method.  It is called as ``sampler(df, k, seed=, label_col=,
    id_col=, **extras)`` and returns a DataFrame."""
    _SAMPLERS[name] = sampler


def sampler_names() -> list[str]:
    return list(_SAMPLERS)


def downsample(
    df: DataFrame, method: str, k: int | None = None, seed: int | None = 42,
    label_col: str = "label", id_col: str = "row_id", on_error: str = "raise", **extras,
) -> DataFrame:
    """Reduce ``df`` to ``k`` rows by the named method.

    ``none`` (any case) returns the table.  So does a ``k`` that is not smaller
    than the table, whatever the method.  Extra arguments reach the sampler.
    ``on_error="return_input"`` answers a failing sampler with the whole table.
    """
    if on_error not in ("raise", "return_input"):
        raise ValueError(f"on_error has to be 'raise' or 'return_input', not {on_error!r}")
    if method.lower() == "none":
        return df
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise ValueError("a positive whole number k is required")
    if k >= df.count():
        return df
    if method not in _SAMPLERS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(_SAMPLERS)}")
    try:
        return _SAMPLERS[method](
            df, k, seed=seed, label_col=label_col, id_col=id_col, **extras
        )
    except NotImplementedError:
        raise
    except Exception as error:
        if on_error == "raise":
            raise
        print(f"warning: method {method!r} failed, returning the input: {error}")
        return df
