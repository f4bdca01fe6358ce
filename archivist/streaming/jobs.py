"""Job policies as column expressions: states, leases, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivist.operators.catalog import clamp

LEASE_SECONDS, ATTEMPTS, PERMANENT_SECONDS = 30, 3, 2
#: Seconds before each retry. Fixed values.
BACKOFF = (1, 4, 15)
#: Which state may follow which. Fixed values.
MOVES = {"pending": ("running", "cancelled"), "running": ("completed", "failed", "cancelled", "pending")}


def legal(before: Column, after: Column) -> Column:
    allowed = F.lit(False)
    for state, following in MOVES.items():
        allowed = allowed | ((before == state) & after.isin(*following))
    return (before.isNull() & (after == "pending")) | F.coalesce(allowed, F.lit(False))


def current(events: DataFrame) -> DataFrame:
    """The last state of each job from events of (job_id, seq, state, processed)."""
    return events.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"), F.max_by("processed", "seq").alias("processed"), F.max("seq").alias("seq"))


#: Length of a list of jobs, and the longest; how many ended ones are shown. Fixed values.
LISTED, MOST_LISTED, RECENT = 50, 100, 8


def listed(jobs: DataFrame, limit: float | None = None, offset: int = 0) -> DataFrame:
    """Jobs of (job_id, state, ...), newest first."""
    return jobs.orderBy(F.desc("job_id")).offset(max(0, offset)).limit(clamp(limit, LISTED, MOST_LISTED))


def recent(jobs: DataFrame, n: int = RECENT) -> DataFrame:
    """The jobs that ended last."""
    return jobs.filter(F.col("state").isin("completed", "failed", "cancelled")).orderBy(F.desc("job_id")).limit(n)


def waiting(jobs: DataFrame) -> DataFrame:
    """The jobs that wait, in the order in which they will run."""
    return jobs.filter(F.col("state") == "pending").orderBy("job_id")


def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest pending job, if none runs."""
    busy = jobs.filter("state = 'running'").limit(1).select(F.lit(1).alias("_busy"))
    return jobs.filter("state = 'pending'").orderBy("job_id").limit(1).join(busy, how="left_anti", on=F.lit(True))


def reclaimed(state: Column, lease_ends: Column, now: Column, alive: Column, owned: Column, cancel: Column, spool: Column | None = None) -> Column:
    """What becomes of a running job: defer, cancelled, pending (progress is kept), or failed if its spooled file is gone."""
    fresh = (lease_ends > now) & alive & owned
    again = F.lit("pending") if spool is None else F.when(spool, "pending").otherwise("failed")
    return F.when(state != "running", state).when(fresh, "defer").when(cancel, "cancelled").otherwise(again)


def retry(attempt: Column, seconds: Column, failed: Column) -> Column:
    """Seconds to wait before the next attempt; null if there is none. A failure within two seconds is permanent."""
    wait = F.lit(None).cast("int")
    for k, s in reversed(list(enumerate(BACKOFF[: ATTEMPTS], 1))):
        wait = F.when(attempt == k, s).otherwise(wait)
    return F.when(failed & (seconds >= PERMANENT_SECONDS), wait)


def fingerprint(*columns: str) -> Column:
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
