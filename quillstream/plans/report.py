"""Reports and measures over finished tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_counts(markers: DataFrame, *keys: str) -> DataFrame:
    """(keys, status, n), sorted by status name."""
    return markers.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n")).orderBy(*keys, "status")


def discarded(markers: DataFrame) -> DataFrame:
    return markers.groupBy("script_id").agg(F.count_if(F.col("status") == "DISCARDED").alias("n_discarded"))


def shown_question(question: Column, best: Column, status: Column) -> Column:
    """The question, or its likeliest candidate with a question mark where none is settled."""
    open_ = question.isNull() & (status != "DISCARDED") & best.isNotNull()
    return F.when(question.isNotNull(), question).when(open_, F.concat(F.lit("?"), best)).otherwise("-")


def marker_lines(markers: DataFrame) -> DataFrame:
    """(script_id, page_index, line): one line of text for each marker that is not discarded."""
    best = F.get("candidate_list", F.lit(0))["question_id"]
    rows = markers.where("status <> 'DISCARDED'")
    number = lambda c: F.coalesce(F.format_string("%.2f", c), F.lit("-"))
    line = F.format_string(
        "p%03d %-12s %-16s %-10s rec=%s res=%s %s",
        "page_index", shown_question(F.col("question"), best, F.col("status")), "status", "resolution_method",
        number("recognition_confidence"), number("resolution_confidence"), F.array_join(F.concat("review_reasons", "parse_flags"), ","),
    )
    return rows.select("script_id", "page_index", "marker_y", line.alias("line")).orderBy("script_id", "page_index", "marker_y")


def page_lines(pages: DataFrame) -> DataFrame:
    line = F.format_string("p%03d %-12s %-16s %-8s markers=%d", "page_index", "page_role", "processing_status", F.coalesce("content_class", F.lit("-")), F.coalesce("marker_count", F.lit(0)))
    return pages.select("script_id", "page_index", line.alias("line")).orderBy("script_id", "page_index")


def script_report(pages: DataFrame, markers: DataFrame, flags: DataFrame) -> DataFrame:
    """(script_id, part, line): the lines of a script's report, in order: its pages, its markers, counts and flags."""
    head = lambda n, title: F.struct(F.lit(n).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("c"), F.lit(title).alias("line"))
    scripts = pages.select("script_id").distinct()
    heads = scripts.select("script_id", F.explode(F.array(*(head(n, t) for n, t in enumerate(("PAGES", "MARKERS", "SUMMARY"))))).alias("x"))
    page = page_lines(pages).select("script_id", F.struct(F.lit(0).alias("a"), F.col("page_index").alias("b"), F.lit(0).alias("c"), "line").alias("x"))
    marker = marker_lines(markers).select("script_id", F.struct(F.lit(1).alias("a"), F.col("page_index").alias("b"), F.col("marker_y").alias("c"), "line").alias("x"))
    counts = status_counts(markers, "script_id").select("script_id", F.struct(F.lit(2).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.format_string("%s=%d", "status", "n").alias("line")).alias("x"))
    detail = flags.select("script_id", F.posexplode("flag_details").alias("at", "line"))
    detail = detail.select("script_id", F.struct(F.lit(2).alias("a"), F.lit(1).alias("b"), F.col("at").alias("c"), "line").alias("x"))
    every = heads.unionByName(page).unionByName(marker).unionByName(counts).unionByName(detail)
    return every.select("script_id", "x.*").orderBy("script_id", "a", "b", "c", "line").select("script_id", F.get(F.array(*map(F.lit, ("PAGES", "MARKERS", "SUMMARY"))), F.col("a")).alias("part"), "line")


def exit_code(pages: DataFrame) -> int:
    """1 if a page has failed or a script has no pages, else 0."""
    return int(pages.isEmpty() or not pages.where(F.col("processing_status").startswith("FAILED")).isEmpty())


def acceptance(markers: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of measures against truth (marker_result_id, true_question): beyond the automatic run."""
    df = truth.join(markers.select("marker_result_id", "question", "status"), "marker_result_id", "left")
    share = lambda part, of: F.when(F.sum(of.cast("long")) > 0, F.sum((part & of).cast("long")) / F.sum(of.cast("long")))
    every, right = F.lit(True), F.coalesce(F.col("question") == F.col("true_question"), F.lit(False))
    accepted = F.coalesce(F.col("status") == "ACCEPTED", F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("status").isNotNull(), every).alias("recall"),
        share(right, every).alias("resolved_right"),
        share(~right, accepted).alias("wrong_auto_accept"),
        share(F.coalesce(F.col("status") == "REVIEW_REQUIRED", F.lit(False)), every).alias("review_rate"),
    )


def review_rates(markers: DataFrame) -> DataFrame:
    """(reason, n): how many markers each reason sends to review."""
    return markers.where("status = 'REVIEW_REQUIRED'").select(F.explode("review_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def isotonic(df: DataFrame, raw: str, hit: str, bins: int = 100) -> list[tuple[float, float]]:
    """Calibration points by pooling adjacent violators over at most ``bins`` bins of the raw confidence."""
    rows = df.groupBy(F.floor(F.col(raw) * bins).alias("b")).agg(F.avg(raw).alias("x"), F.avg(F.col(hit).cast("double")).alias("y"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    blocks: list[list[float]] = []
    for r in rows:
        blocks.append([r["x"] * r["n"], r["y"] * r["n"], r["n"]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [(x / n, y / n) for x, y, n in blocks]


def capacity(scripts_per_day: float, pages_per_script: float, seconds_per_page: float, hours: float = 20.0, use: float = 0.7) -> float:
    """Cores that a daily load takes."""
    return scripts_per_day * pages_per_script * seconds_per_page / (hours * 3600 * use)
