from repometrics.operators import (
    aggregates,
    curves,
    filters,
    joins,
    ordering,
    reports,
    reshape,
    sets,
    stats,
    textlint,
)

__all__ = [
    "aggregates", "curves", "filters", "joins", "ordering", "reports", "reshape", "sets", "stats", "textlint",
]
