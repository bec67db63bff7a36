"""TF-IDF weights, computed on the driver from the statistics of a query's own terms."""

from __future__ import annotations

import math

#: Scores are rounded before they are compared, so that summation order can't reorder ties.
DIGITS = 6


def idf(doc_freq: int, n_docs: int) -> float:
    return 1.0 + math.log(n_docs / (doc_freq + 1)) if n_docs else 0.0


def query_norm(sum_of_squares: float) -> float:
    return 1.0 / math.sqrt(sum_of_squares) if sum_of_squares > 0 else 1.0
