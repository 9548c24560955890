"""Completion of scripts from a stream of page results (beyond what runs in batch)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINAL = ("PROCESSED", "SKIPPED_BY_ROLE", "FAILED_PERMANENT")
OUT = "script_id string, page_count int, n_failed int, is_complete boolean"
STATE = "page_count int, pages array<int>, failed array<int>"


def job_id(df: DataFrame, version: str) -> DataFrame:
    """Adds job_id: the same page under the same version is the same job, so a repeated message changes nothing."""
    return df.withColumn("job_id", F.substring(F.sha2(F.concat_ws("|", "script_id", F.col("page_index").cast("string"), F.lit(version)), 256), 1, 16))


#: Where a page job may go from each of its states; a retryable failure is queued again while attempts are left.
MOVES = {"QUEUED": ("PROCESSING",), "PROCESSING": ("COMPLETED", "FAILED_RETRYABLE", "FAILED_PERMANENT"), "FAILED_RETRYABLE": ("QUEUED", "FAILED_PERMANENT")}


def job_states(events: DataFrame, max_attempts: int) -> DataFrame:
    """(job_id, status, attempts, rejected) after all events (job_id, seq, status), in order of seq.

    A job begins as QUEUED. An event that MOVES does not allow is rejected and changes nothing; a retryable failure of
    the last attempt is permanent. A repeated final event is no move. Each job's few events are folded in one row.
    """
    start = F.struct(F.lit("QUEUED").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("rejected"))
    allowed = F.create_map(*(x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))

    def step(acc, event):
        fits = F.coalesce(F.array_contains(F.try_element_at(allowed, acc["status"]), event["status"]), F.lit(False))
        attempts = acc["attempts"] + (fits & (event["status"] == "PROCESSING")).cast("int")
        status = F.when((event["status"] == "FAILED_RETRYABLE") & (acc["attempts"] >= max_attempts), "FAILED_PERMANENT").otherwise(event["status"])
        again = acc["status"] == event["status"]
        return F.struct(
            F.when(fits, status).otherwise(acc["status"]).alias("status"), attempts.alias("attempts"),
            (acc["rejected"] + (~fits & ~again).cast("int")).alias("rejected"),
        )

    jobs = events.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("seq", "status"))).alias("_events"))
    return jobs.select("job_id", F.aggregate("_events", start, step).alias("s")).select("job_id", "s.*")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, pages, failed = state.get if state.exists else (0, [], [])
    pages, failed = set(pages), set(failed)
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], count, len(failed), False)], columns=["script_id", "page_count", "n_failed", "is_complete"])
        return
    for df in batches:
        count = max(count, int(df["page_count"].max()))
        done = df[df["processing_status"].isin(FINAL)]
        pages |= set(done["page_index"].astype(int))
        failed |= set(done.loc[done["processing_status"] == "FAILED_PERMANENT", "page_index"].astype(int))
    if count and len(pages) >= count:
        state.remove()
        yield pd.DataFrame([(key[0], count, len(failed), True)], columns=["script_id", "page_count", "n_failed", "is_complete"])
    else:
        state.update((count, sorted(pages), sorted(failed)))
        state.setTimeoutDuration(24 * 3600 * 1000)


def completed_scripts(page_results: DataFrame) -> DataFrame:
    """Scripts whose every page has a final status, as they complete; one that waits a day comes out incomplete.

    page_results: a stream of script_id, page_index, page_count, processing_status. State is one row for each open
    script, of the size of its page list.
    """
    keyed = page_results.select("script_id", "page_index", "page_count", "processing_status").groupBy("script_id")
    return keyed.applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
