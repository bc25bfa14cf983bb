"""Quarry: tabular profiling, cleaning, feature engineering and selection as Spark DataFrame plans."""

__version__ = "0.1.0"
