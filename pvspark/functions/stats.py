"""Small numeric expressions shared by the reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: similarity from which a pair counts as exact.
EXACT_SIMILARITY = 0.9999


def pct(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, half to even; 0 when ``whole`` is 0."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
    return F.coalesce(F.bround(ratio, 2), F.lit(0.0))
