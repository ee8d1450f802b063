"""Repository-metrics analytics on Spark: DataFrame in, DataFrame out."""

from repometrics import constants, functions, operators, plans, schemas, session, sources

__all__ = ["constants", "functions", "operators", "plans", "schemas", "session", "sources"]
