"""corpusgauge: source-corpus analytics and change-review jobs as Spark DataFrames."""

__version__ = "0.1.0"
