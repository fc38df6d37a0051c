"""Analysis of multi-channel event trains on Spark DataFrames."""

from .layout import Layout, Slicing
from .plans.analysis import Analysis, add_features, add_synchrony, detect_bursts, run

__all__ = ["Analysis", "Layout", "Slicing", "add_features", "add_synchrony", "detect_bursts", "run"]
