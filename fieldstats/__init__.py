"""Time-series and climatology operators for Spark tables."""

from fieldstats.dataset import Dataset, list_datasets
from fieldstats.model import Result, Roles
from fieldstats.operators.registry import ANALYSES, CHARTS, analyze, chart
from fieldstats.session import connect

__all__ = ["ANALYSES", "CHARTS", "Dataset", "Result", "Roles", "analyze", "chart", "connect", "list_datasets"]
