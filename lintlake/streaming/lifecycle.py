"""Findings over time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.operators.hits import timestamp

_LATEST = "coalesce(current.{0}, previous.{0}) AS {0}"


def merge_lifecycle(
    previous: DataFrame, current: DataFrame, now: datetime | str | None = None, scanned: DataFrame | None = None
) -> DataFrame:
    """The finding table after a run, from the table before and the run's findings.

    A finding keeps the time it was first seen; one that is gone is `fixed` and
    keeps its last-seen time; one that came back is `open` again.  What was set
    to `ignored`, `false_positive` or `in_progress` stays so while it is found,
    and the first two also afterwards.  `scanned` has the `file`s that the run
    covered: findings of other files stay as they were.  Without it the run
    covered all.
    """
    if scanned is None:
        previous = previous.withColumn("_scanned", F.lit(True))
    else:
        files = scanned.select("file").distinct().withColumn("_seen", F.lit(True))
        previous = previous.join(files, "file", "left").withColumn("_scanned", F.coalesce("_seen", F.lit(False)))
    kept = "id first_seen last_seen status".split()
    others = [c for c in current.columns if c not in kept]
    joined = previous.alias("previous").join(current.alias("current"), "id", "full_outer")
    joined = joined.withColumn("_now", timestamp(now))
    found, known = "current.status IS NOT NULL", "previous.status IS NOT NULL"
    status = f"""CASE
        WHEN NOT ({known}) THEN 'open'
        WHEN previous.status IN ('ignored', 'false_positive') THEN previous.status
        WHEN NOT ({found}) AND NOT previous._scanned THEN previous.status
        WHEN NOT ({found}) THEN 'fixed'
        WHEN previous.status = 'in_progress' THEN previous.status
        ELSE 'open' END AS status"""
    shaped = joined.selectExpr(
        "id",
        *[_LATEST.format(f"`{c}`") if c in previous.columns else f"current.`{c}`" for c in others],
        status,
        "coalesce(previous.first_seen, _now) AS first_seen",
        f"IF({found}, _now, previous.last_seen) AS last_seen",
    )
    return shaped.select(*current.columns)


def lifecycle_stream(findings: DataFrame, watermark: str = "1 day", span: str = "1 day") -> DataFrame:
    """First and last sighting per finding and time span, for update mode.

    `findings` is a stream with `seen_at`.  State is kept per finding and span
    and dropped once the watermark passes the span, so it does not grow with
    the age of the stream; `merge_sightings` folds the spans into the table.
    """
    return (
        findings.withWatermark("seen_at", watermark)
        .groupBy(F.window("seen_at", span), "id")
        .agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
        .select("id", "first_seen", "last_seen")
    )


def merge_sightings(known: DataFrame, sightings: DataFrame) -> DataFrame:
    """(id, first_seen, last_seen) of both tables together."""
    both = known.select("id", "first_seen", "last_seen").unionByName(sightings)
    return both.groupBy("id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
