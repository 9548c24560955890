"""Checks across the pages of a script: duplicates, order, counts, missed and failed pages. Identifiers never change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text
from quillstream.operators.resolve import _small
from quillstream.schema import LIVE

SCRIPT = ("script_id",)


def ordered(markers: DataFrame) -> DataFrame:
    """Live markers with a question, numbered from 0 as they come in their script (seq)."""
    live = markers.where(F.col("status").isin(*LIVE) & F.col("question").isNotNull())
    come = Window.partitionBy("script_id").orderBy("page_index", "marker_y", "candidate_pos")
    return live.withColumn("seq", F.row_number().over(come) - 1)


def duplicates(rows: DataFrame) -> DataFrame:
    """ordered rows with is_duplicate."""
    return rows.withColumn("is_duplicate", F.count(F.lit(1)).over(Window.partitionBy("script_id", "question")) > 1)


def out_of_order(rows: DataFrame) -> DataFrame:
    """ordered rows (with ord, the question's place in the list) with is_late, is_passed and after_seq.

    is_late: a larger ord came before. after_seq: the first row that reached the largest ord so far. is_passed: a row that
    is after_seq of a late one.
    """
    come = Window.partitionBy("script_id").orderBy("seq")
    before = come.rowsBetween(Window.unboundedPreceding, -1)
    # of rows with the largest ord the first counts: the largest pair of ord and -seq
    top = F.max(F.when(F.col("ord").isNotNull(), F.struct("ord", (-F.col("seq")).alias("early")))).over(before)
    rows = rows.withColumn("_top", top)
    late = F.coalesce(F.col("ord") < F.col("_top.ord"), F.lit(False))
    rows = rows.withColumn("is_late", late).withColumn("after_seq", F.when(late, -F.col("_top.early"))).drop("_top")
    # a row is passed while it is the holder: some later row names it
    named = F.collect_set("after_seq").over(Window.partitionBy("script_id"))
    return rows.withColumn("is_passed", F.array_contains(named, F.col("seq")))


def answer_counts(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(script_id, n_questions, min_answers, max_answers, is_mismatch); rules has one row for each exam.

    rows has every script (question null for scripts without live markers).
    """
    counts = rows.groupBy("script_id", "exam_id").agg(F.countDistinct("question").alias("n_questions"))
    counts = counts.join(_small(rules), "exam_id", "left")
    wrong = (F.col("n_questions") < F.col("min_answers")) | (F.col("n_questions") > F.col("max_answers"))
    return counts.withColumn("is_mismatch", F.coalesce(wrong, F.col("n_questions") < F.col("min_answers"), F.col("n_questions") > F.col("max_answers"), F.lit(False)))


def first_written(pages: DataFrame) -> DataFrame:
    """(script_id, first_page): the first processed answer page with writing."""
    written = (F.col("page_role") == "ANSWER") & (F.col("processing_status") == "PROCESSED") & F.col("content_class").isin("NORMAL", "SPARSE")
    return pages.where(written).groupBy("script_id").agg(F.min("page_index").alias("first_page"))


def failed_pages(pages: DataFrame) -> DataFrame:
    failed = F.col("processing_status").isin("FAILED_PERMANENT", "FAILED_RETRYABLE")
    return pages.groupBy("script_id").agg(
        F.max(failed).alias("is_incomplete"), F.sort_array(F.collect_list(F.when(failed, F.col("page_index")))).alias("failed_pages")
    )


def flagged(markers: DataFrame, vocabulary: DataFrame, rules: DataFrame) -> DataFrame:
    """markers with status and review_reasons after the script's checks; a status is only ever lowered to review."""
    places = vocabulary.select("exam_id", F.col("canonical").alias("question"), F.col("ord"))
    rows = out_of_order(duplicates(ordered(markers).join(_small(places), ["exam_id", "question"], "left")))
    counts = answer_counts(rows, rules).select("script_id", "is_mismatch")
    rows = rows.join(counts, "script_id").select(
        "script_id", "page_index", "candidate_pos",
        text.present(
            (F.col("is_duplicate"), "DUPLICATE_IN_SCRIPT"), (F.col("is_late") | F.col("is_passed"), "OUT_OF_ORDER"), (F.col("is_mismatch"), "ANSWER_COUNT_MISMATCH")
        ).alias("_more"),
    )
    out = markers.join(rows, ["script_id", "page_index", "candidate_pos"], "left")
    more = F.coalesce("_more", F.array().cast("array<string>"))
    lowered = F.when((F.col("status") == "ACCEPTED") & (F.size(more) > 0), "REVIEW_REQUIRED").otherwise(F.col("status"))
    return out.withColumn("review_reasons", text.in_order_once(F.col("review_reasons"), more)).withColumn("status", lowered).drop("_more")


def page_counts(pages: DataFrame, markers: DataFrame) -> DataFrame:
    """pages with marker_count: accepted, in review or unresolved."""
    kept = markers.where(F.col("status").isin(*LIVE, "UNRESOLVED")).groupBy("script_id", "page_index").agg(F.count(F.lit(1)).alias("marker_count"))
    return pages.drop("marker_count").join(kept, ["script_id", "page_index"], "left").withColumn("marker_count", F.coalesce("marker_count", F.lit(0)).cast("int"))


def script_flags(pages: DataFrame, markers: DataFrame, vocabulary: DataFrame, rules: DataFrame) -> DataFrame:
    """(script_id, flags, flag_details) for each script of pages; flags in the order of the checks.

    Details name duplicates as they first come, late markers in order, the count, and the pages missed or failed.
    """
    places = vocabulary.select("exam_id", F.col("canonical").alias("question"), F.col("ord"))
    rows = out_of_order(duplicates(ordered(markers).join(_small(places), ["exam_id", "question"], "left")))
    twice = rows.where("is_duplicate").groupBy("script_id", "question").agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "page_index"))), lambda x: x["page_index"]).alias("on")
    )
    twice = twice.select("script_id", F.lit(0).alias("phase"), "seq", F.lit("DUPLICATE_QUESTION").alias("flag"), F.format_string("Question %s appears %d times (pages %s)", "question", "n", F.array_join(F.col("on").cast("array<string>"), ", ")).alias("detail"))
    held = rows.select("script_id", F.col("seq").alias("after_seq"), F.col("question").alias("_q"), F.col("page_index").alias("_p"))
    late = rows.where("is_late").join(held, ["script_id", "after_seq"])
    late = late.select("script_id", F.lit(1).alias("phase"), "seq", F.lit("OUT_OF_ORDER").alias("flag"), F.format_string("Question %s (page %d) after %s (page %d)", "question", "page_index", "_q", "_p").alias("detail"))
    scripts = pages.select("script_id", "exam_id").distinct() if "exam_id" in pages.columns else pages.select("script_id").distinct().join(rules.select("exam_id"), F.lit(True))
    every = scripts.join(rows.select("script_id", "question"), "script_id", "left")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    count = answer_counts(every, rules).where("is_mismatch")
    count = count.select("script_id", F.lit(2).alias("phase"), F.lit(0).alias("seq"), F.lit("ANSWER_COUNT_MISMATCH").alias("flag"), F.format_string("%d distinct questions found; rules allow %s..%s", "n_questions", text_of("min_answers"), text_of("max_answers")).alias("detail"))
    seen = rows.select("script_id").distinct().withColumn("_any", F.lit(True))
    on_page = markers.where(F.col("status").isin(*LIVE, "UNRESOLVED")).select("script_id", F.col("page_index").alias("first_page")).distinct().withColumn("_here", F.lit(True))
    first = first_written(pages).join(seen, "script_id", "left").join(on_page, ["script_id", "first_page"], "left").where("_any is null or _here is null")
    none = F.col("_any").isNull()
    missed = first.select(
        "script_id", F.lit(3).alias("phase"), F.lit(0).alias("seq"), F.when(none, "NO_MARKERS").otherwise("POSSIBLE_MISSED_MARKER").alias("flag"),
        F.when(none, "Answer pages contain writing but no question markers were found").otherwise(F.format_string("First written answer page (%d) has no marker", "first_page")).alias("detail"),
    )
    failed = failed_pages(pages).where("is_incomplete")
    failed = failed.select("script_id", F.lit(4).alias("phase"), F.lit(0).alias("seq"), F.lit("INCOMPLETE").alias("flag"), F.format_string("Pages failed: [%s]", F.array_join(F.col("failed_pages").cast("array<string>"), ", ")).alias("detail"))
    found = twice.unionByName(late).unionByName(count).unionByName(missed).unionByName(failed)
    lists = found.groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct("phase", "seq", "flag", "detail"))).alias("_all"))
    lists = lists.select("script_id", F.array_distinct(F.transform("_all", lambda x: x["flag"])).alias("flags"), F.transform("_all", lambda x: x["detail"]).alias("flag_details"))
    empty = F.array().cast("array<string>")
    return scripts.join(lists, "script_id", "left").select("script_id", F.coalesce("flags", empty).alias("flags"), F.coalesce("flag_details", empty).alias("flag_details"))
