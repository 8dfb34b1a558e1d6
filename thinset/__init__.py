"""Shrink labelled text tables to representative training subsets on Spark."""

from .operators.coverage import coverage_search, sample_acs
from .operators.cover import duplicate_cover, max_cover
from .operators.degree import cap_degree, cap_degree_mutual
from .operators.sampling import (
    holdout_split, sample_groups, sample_random, sample_score, sample_selection,
    sample_stratified, shuffle_rows,
)
from .operators.similarity import cosine_edges
from .plans.downsample import downsample, register_sampler
from .plans.experiment import run_experiment, size_grid, sweep
from .sources.files import load_dataset

__all__ = [
    "cap_degree", "cap_degree_mutual", "cosine_edges", "coverage_search", "downsample",
    "duplicate_cover", "holdout_split", "load_dataset", "max_cover", "register_sampler",
    "run_experiment", "sample_acs", "sample_groups", "sample_random", "sample_score",
    "sample_selection", "sample_stratified", "shuffle_rows", "size_grid", "sweep",
]
