"""tally — exploratory table analytics on Spark.

Every operator is a plain function from DataFrames to a DataFrame; the work
runs on Spark (Catalyst plans, shuffles, windows, Spark ML).  Nothing is
pulled whole through the driver: the only driver-side values are bounded
summaries (a fitted model, a handful of centroids, a one-row statistic).
"""

__all__ = ["operators", "sources", "functions", "plans", "streaming", "session"]
