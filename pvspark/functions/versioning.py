"""Version labels: ordering key and selection predicate."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """Text that sorts like a version: each run of digits compares as a number, however long."""
    runs = F.regexp_extract_all(version, F.lit(r"\d+|\D+"), F.lit(0))

    def number(r: Column) -> Column:
        digits = F.regexp_replace(r, "^0+(?=.)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), number(r)).otherwise(r)), "")


def matches_tag(version: Column, tag_regex: str) -> Column:
    """Regex anchored at the start only."""
    return version.rlike(f"^(?:{tag_regex})")
