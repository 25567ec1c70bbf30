"""Most popular repositories of a metadata table."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGE_DAYS = 5 * 365


def popular_repos(
    repos: DataFrame,
    language: str = "java",
    count: int = 10,
    min_stars: float = 1000,
    org: str | None = None,
    as_of: datetime.date | None = None,
) -> DataFrame:
    """Top ``count`` repositories by stars.

    Columns used: ``language, org, stargazers_count, created, full_name``. With
    an organisation neither stars nor age matter; otherwise both bounds are
    strict. The predicates are plain comparisons, so a columnar source prunes
    by them, and the top-N never sorts more than N rows per task.
    """
    chosen = repos.filter(F.col("language") == language)
    if org:
        chosen = chosen.filter(F.col("org") == org)
    else:
        today = as_of or datetime.date.today()
        oldest = today - datetime.timedelta(days=AGE_DAYS)
        chosen = chosen.filter(
            (F.col("stargazers_count") > min_stars) & (F.col("created") > F.lit(oldest))
        )
    return chosen.orderBy(F.desc("stargazers_count"), "full_name").limit(max(0, count))
