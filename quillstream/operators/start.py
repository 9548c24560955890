"""Where the answer of a marker begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.config import Start
from quillstream.functions import geometry

# --- fixed values: confidence of a start ---
SAME_LINE, NEAR_LINE, FURTHER_LINE, NO_INK, FALLBACK = 0.95, 0.85, 0.70, 0.30, 0.20


def level(offset: Column) -> Column:
    """Confidence of a start found offset lines below the marker; null for none found."""
    return F.when(offset.isNull(), NO_INK).when(offset == 0, SAME_LINE).when(offset <= 2, NEAR_LINE).otherwise(FURTHER_LINE)


#: What orders candidates of one y and candidate_pos after the surer detection, as far as there are such columns.
_TIES = ("box", "raw", "recognition_confidence_raw", "exam_id", "polygon")


def next_band(df: DataFrame) -> DataFrame:
    """df with the band of the live candidate that follows on the page; null for discarded ones.

    Candidates follow each other by y and candidate_pos, and where both are equal by the rest of what was observed, the
    surer detection first: the order in which rows arrive decides nothing.
    """
    live = F.col("discard_reason").isNull()
    surer = [F.col("detection_confidence").desc()] if "detection_confidence" in df.columns else []
    follows = Window.partitionBy("script_id", "page_index", live).orderBy("y", "candidate_pos", *surer, *(c for c in _TIES if c in df.columns))
    return df.withColumn("next_band", F.when(live, F.lead("band").over(follows)))


def search(markers: DataFrame, settings: Start) -> DataFrame:
    """Adds start_x, start_y, start_method, start_confidence and lines_below.

    Reads band, next_band, box, dpi, landmarks_found, margin_rule_x, ruled_line_ys and band_ink (share of ink for each
    band). The marker's own band always counts, others up to the next marker's; above the first line counts as it.
    """
    c = F.col
    first = F.greatest(F.lit(0), F.coalesce("band", F.lit(0)))
    offsets = F.sequence(F.lit(0), F.lit(settings.max_lines_below))
    free = lambda o: (o == 0) | F.coalesce(first + o < c("next_band"), F.lit(True))
    inked = lambda o: (first + o < F.size("ruled_line_ys")) & F.coalesce(F.get("band_ink", first + o) >= settings.min_ink, F.lit(False))
    offset = F.array_min(F.filter(offsets, lambda o: free(o) & inked(o)))
    landmark = c("landmarks_found") & c("margin_rule_x").isNotNull()
    df = markers.withColumn("lines_below", F.when(landmark, offset))
    at = first + F.coalesce("lines_below", F.lit(0))
    return (
        df.withColumn("start_method", F.when(landmark, "LANDMARK_LINE").otherwise("FALLBACK_OFFSET"))
        .withColumn("start_x", F.when(landmark, c("margin_rule_x") + geometry.mm_to_px(settings.padding_mm, c("dpi"))).otherwise(geometry.x2(c("box")) + geometry.mm_to_px(settings.fallback_mm, c("dpi"))))
        .withColumn("start_y", F.when(landmark, F.get("ruled_line_ys", at)).otherwise(F.greatest(F.lit(0), c("box")["y"] - geometry.mm_to_px(1.0, c("dpi")))))
        .withColumn("start_confidence", F.when(landmark, level(c("lines_below"))).otherwise(FALLBACK))
    )
