"""What becomes of a candidate: discarded, accepted, or sent to review with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.config import Detection, Gate, Grammar, Region
from quillstream.functions import geometry, text


def position(x: Column, width: Column, rule_x: Column, spill_px: Column) -> tuple[Column, Column]:
    """(inside the answer area, position valid); without a rule every position is valid."""
    crosses = (x < rule_x) & (rule_x <= x + width)
    valid = (x + width / 2 < rule_x + spill_px / 2) | crosses
    return F.coalesce(x >= rule_x, F.lit(False)), F.coalesce(valid, F.lit(True))


def implausible(raw: Column, width: Column, height: Column, settings: Detection) -> Column:
    """One letter or digit read from a box much wider than high."""
    return text.single_alnum(raw) & (width > settings.max_single_aspect * height)


def discarded(inside: Column, kind: Column, odd_shape: Column) -> Column:
    """The first reason to discard a candidate by itself; null for a live one."""
    return F.when(inside, "INSIDE_ANSWER_AREA").when(kind == "NOT_A_MARKER", "NOT_A_MARKER_PATTERN").when(odd_shape, "IMPLAUSIBLE_SHAPE")


def header_tokens(df: DataFrame, settings: Grammar, page: tuple[str, ...] = ("script_id", "page_index")) -> DataFrame:
    """df (page keys, kind, band, y, height, discard_reason) with is_header: a live lone prefix that a live marker of its
    page follows within a few lines. A page's markers are few, so each row sees them as one array of its window."""
    live = F.col("discard_reason").isNull()
    marker = F.when(live & (F.col("kind") == "MARKER"), F.struct("band", "y"))
    df = df.withColumn("_markers", F.collect_list(marker).over(Window.partitionBy(*page)))
    near = lambda m: geometry.band_distance(F.col("band"), m["band"], F.col("y"), m["y"], F.col("height")) <= settings.header_lookahead
    followed = F.exists("_markers", lambda m: (m["y"] >= F.col("y")) & near(m))
    return df.withColumn("is_header", live & (F.col("kind") == "PREFIX_ONLY") & followed).drop("_markers")


def threshold(flags: Column, is_colour: Column, settings: Gate) -> Column:
    adjusted = F.array_contains(flags, "NOISE_STRIPPED") | F.array_contains(flags, "LINE_TRIMMED")
    return F.greatest(
        F.lit(settings.min_recognition),
        F.when(adjusted, F.lit(settings.min_adjusted)).otherwise(0.0),
        F.when(~is_colour, F.lit(settings.min_grayscale)).otherwise(0.0),
    )


def decide(df: DataFrame, settings: Gate) -> DataFrame:
    """Adds status and review_reasons.

    Reads kind, discard_reason, outcome, method, resolution_margin, is_confusable, position_valid,
    recognition_confidence, flags, landmarks_found, is_colour, start_method and start_confidence.
    """
    c = F.col
    low = c("recognition_confidence") < threshold(c("flags"), c("is_colour"), settings)
    thin = (c("outcome") == "RESOLVED") & (c("method") == "CONSTRAINED_UNIQUE") & (c("resolution_margin") < settings.min_margin)
    lost = ~c("landmarks_found") | (c("start_method") == "FALLBACK_OFFSET")
    reasons = F.array_distinct(
        text.present(
            (c("outcome") == "AMBIGUOUS", "AMBIGUOUS"),
            (~c("position_valid"), "INVALID_POSITION"),
            (low, "LOW_RECOGNITION_CONFIDENCE"),
            (thin, "AMBIGUOUS"),
            (c("is_confusable"), "AMBIGUOUS"),
            (lost, "LANDMARKS_NOT_FOUND"),
            (~lost & (c("start_confidence") < settings.min_start), "START_UNCERTAIN"),
        )
    )
    none = F.array().cast("array<string>")
    out = (
        F.when(c("discard_reason").isNotNull(), F.struct(F.lit("DISCARDED").alias("status"), none.alias("reasons")))
        .when(c("kind") == "PREFIX_ONLY", F.struct(F.lit("UNRESOLVED").alias("status"), F.array(F.lit("PREFIX_WITHOUT_ID")).alias("reasons")))
        .when(c("outcome") == "NO_MATCH", F.struct(F.lit("UNRESOLVED").alias("status"), F.array(F.lit("NO_MATCH")).alias("reasons")))
        .otherwise(F.struct(F.when(F.size("_reasons") > 0, "REVIEW_REQUIRED").otherwise("ACCEPTED").alias("status"), c("_reasons").alias("reasons")))
    )
    own = [x for x in df.columns if x not in ("status", "review_reasons")]
    df = df.withColumn("_reasons", reasons).withColumn("_gate", out)
    # a generator, so that filters on the status are not moved below it
    return df.select(*own, F.inline(F.array(F.struct(c("_gate.status").alias("status"), c("_gate.reasons").alias("review_reasons")))))


def spill(dpi: Column, settings: Region) -> Column:
    return geometry.mm_to_px(settings.spill_mm, dpi)
