"""Analyzer and length norm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest token count of each step of the one-byte length norm (3 mantissa
# bits, 5 exponent bits) at field boost 1, and the norm from there on.
NORM_STEPS = [
    (1, 1.0),
    (2, 0.625),
    (3, 0.5),
    (5, 0.4375),
    (6, 0.375),
    (8, 0.3125),
    (11, 0.25),
    (17, 0.21875),
    (21, 0.1875),
    (29, 0.15625),
    (41, 0.125),
    (65, 0.109375),
    (84, 0.09375),
    (114, 0.078125),
    (164, 0.0625),
    (257, 0.0546875),
    (335, 0.046875),
    (456, 0.0390625),
    (656, 0.03125),
    (1025, 0.02734375),
    (1338, 0.0234375),
    (1821, 0.01953125),
    (2622, 0.015625),
    (4097, 0.013671875),
    (5350, 0.01171875),
    (7282, 0.009765625),
    (10486, 0.0078125),
    (16385, 0.0068359375),
]


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; null has none."""
    return F.coalesce(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), F.array().cast("array<string>"))


def norm(length: Column) -> Column:
    """Length norm of a field with so many tokens; 0 for an empty field."""
    chain = None
    for least, value in reversed(NORM_STEPS):
        chain = F.when(length >= least, value) if chain is None else chain.when(length >= least, value)
    return chain.otherwise(0.0)
