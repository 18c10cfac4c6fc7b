"""Spark-native analytics engine: import, cleaning, pivots, formulas, statistics, series, models, charts."""
