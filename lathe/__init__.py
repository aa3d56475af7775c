"""Automated tabular regression on Spark: profile, prepare, split, train, rank, audit and chart."""

from lathe.options import Options
from lathe.sources.tables import Dataset, read_csv, read_dataset, read_parquet

__all__ = ["Dataset", "Options", "analyze", "read_csv", "read_dataset", "read_parquet"]


def analyze(*args, **kwargs):
    """See `lathe.plans.analysis.analyze`."""
    from lathe.plans.analysis import analyze as run

    return run(*args, **kwargs)
