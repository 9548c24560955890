"""Candidate boxes: filters, merging of fragments, and suppression of overlapping detections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.config import Detection
from quillstream.functions import geometry

PAGE = ("script_id", "page_index")
#: Rows of pixels that a tile has at least. A fixed value.
LEAST_TILE = 10


def component_filter(df: DataFrame, dpi: Column | float, settings: Detection, rule_x: Column, thin_mm: float = 0.6, tall_mm: float = 10.0) -> DataFrame:
    """Drops specks, boxes too high, ruled-line rests (thin and tall) and what begins at or beyond the rule."""
    area = settings.min_area_mm2 * ((dpi if isinstance(dpi, Column) else F.lit(dpi)) / 25.4) ** 2
    b = F.col("box")
    thin, tall = geometry.mm_to_px(thin_mm, dpi), geometry.mm_to_px(tall_mm, dpi)
    return df.where(
        (F.col("area") >= area)
        & (b["height"] <= geometry.mm_to_px(settings.max_height_mm, dpi))
        & ~((b["width"] <= thin) & (b["height"] >= tall))
        & F.coalesce(b["x"] < rule_x, F.lit(True))
    )


def merged_filter(df: DataFrame, dpi: Column | float, settings: Detection) -> DataFrame:
    """Drops merged candidates that are too low or narrow, and slivers at the page edge."""
    b = F.col("box")
    sliver = (b["x"] <= 1) & (b["width"] <= geometry.mm_to_px(1.5, dpi))
    return df.where((b["height"] >= geometry.mm_to_px(settings.min_height_mm, dpi)) & (b["width"] >= 2) & ~sliver)


def margin_filter(df: DataFrame, dpi: Column | float, rule_x: Column, pitch: Column, region_width: Column) -> DataFrame:
    """Text-detector boxes: left of the rule, no higher than 1.8 lines, not in the padding."""
    b = F.col("box")
    left = F.coalesce(b["x"] < rule_x - geometry.mm_to_px(1.0, dpi), F.lit(True))
    low = F.coalesce(b["height"] <= F.floor(1.8 * pitch), F.lit(True))
    return df.where(left & low & (b["x"] < region_width))


def valuer_filter(df: DataFrame, dpi: float, min_mm2: float = 2.0) -> DataFrame:
    return df.where(F.col("area") >= min_mm2 * (dpi / 25.4) ** 2)


def merge_by_line(df: DataFrame, gap_px: Column | int) -> DataFrame:
    """Fragments of one band joined where the gap to all before them is gap_px at most.

    df: PAGE, band (not null), box, detection_confidence, polygon. A new island begins where x lies further than the gap
    beyond the largest right edge so far; for gaps of 0 or more that is what repeated pairwise merging ends in.
    """
    gap = gap_px if isinstance(gap_px, Column) else F.lit(gap_px)
    b = F.col("box")
    along = Window.partitionBy(*PAGE, "band").orderBy(b["x"], geometry.x2(b), b["y"], b["height"])
    reach = F.max(geometry.x2(b)).over(along.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.coalesce((b["x"] - reach > gap).cast("int"), F.lit(1)))
    df = df.withColumn("island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    x, y = F.min(b["x"]), F.min(b["y"])
    out = df.groupBy(*PAGE, "band", "island").agg(
        geometry.box(x, y, F.max(geometry.x2(b)) - x, F.max(geometry.y2(b)) - y).alias("box"),
        F.min("detection_confidence").alias("detection_confidence"),
        F.count(F.lit(1)).alias("fragments"),
        F.min_by("polygon", b["x"]).alias("polygon"),
    )
    return out.withColumn("polygon", F.when(F.col("fragments") == 1, F.col("polygon"))).drop("island")


def merge_by_overlap(df: DataFrame, gap_px: Column | int, least: float = 0.3) -> DataFrame:
    """Merging on pages without ruled lines: boxes that share enough height, pair by pair until none is left.

    The outcome depends on the order of merges, so each page's few candidates are merged in Python, in (y, x) order.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        rows = [dict(r) for r in page.sort_values(["y", "x", "candidate_pos"]).to_dict("records")]
        i = 0
        while i < len(rows):
            for j in range(i + 1, len(rows)):
                a, b = rows[i], rows[j]
                lap = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
                gap = max(a["x"], b["x"]) - min(a["x"] + a["width"], b["x"] + b["width"])
                if lap / max(1, min(a["height"], b["height"])) >= least and gap <= a["gap"]:
                    x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
                    a["width"] = max(a["x"] + a["width"], b["x"] + b["width"]) - x
                    a["height"] = max(a["y"] + a["height"], b["y"] + b["height"]) - y
                    a["x"], a["y"] = x, y
                    a["detection_confidence"] = min(a["detection_confidence"], b["detection_confidence"])
                    a["fragments"] += b["fragments"]
                    del rows[j]
                    i = -1
                    break
            i += 1
        return pd.DataFrame(rows, columns=list(page.columns))

    flat = df.select(*PAGE, "candidate_pos", *(F.col("box")[k].alias(k) for k in ("x", "y", "width", "height")), "detection_confidence", F.lit(1).alias("fragments"), (gap_px if isinstance(gap_px, Column) else F.lit(gap_px)).cast("int").alias("gap"))
    merged = flat.groupBy(*PAGE).applyInPandas(run, flat.schema)
    return merged.select(*PAGE, geometry.box(*(F.col(k) for k in ("x", "y", "width", "height"))).alias("box"), "detection_confidence", "fragments")


def suppressed(df: DataFrame, settings: Detection) -> DataFrame:
    """Non-maximum suppression: by confidence, a box is kept unless it overlaps a kept one of its page too much.

    A fold over each page's boxes, most confident first, ties in candidate order.
    """
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("detection_confidence")).alias("rank"), "candidate_pos", "box")))
    element = "struct<rank:double,candidate_pos:int,box:struct<x:int,y:int,width:int,height:int>>"

    def step(kept: Column, one: Column) -> Column:
        clash = F.exists(kept, lambda k: geometry.iou(k["box"], one["box"]) >= settings.nms_iou)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(one)))

    pages = df.groupBy(*PAGE).agg(ranked.cast(f"array<{element}>").alias("_all"))
    kept = F.aggregate("_all", F.array().cast(f"array<{element}>"), step)
    out = pages.select(*PAGE, F.explode(kept).alias("k"))
    return out.select(*PAGE, F.col("k.candidate_pos").alias("candidate_pos"), F.col("k.box").alias("box"), (-F.col("k.rank")).alias("detection_confidence"))


def numbered(df: DataFrame) -> DataFrame:
    """Candidates numbered from 1 by (y, x) in their page, ties by candidate_pos."""
    come = Window.partitionBy(*PAGE).orderBy(F.col("box")["y"], F.col("box")["x"], "candidate_pos")
    return df.withColumn("number", F.row_number().over(come))


def tiles(pages: DataFrame, settings: Detection, default_mm: float = 9.4) -> DataFrame:
    """(PAGE, tile, top, bottom) of a page's region: strips of tile_lines pitches that overlap by tile_overlap of them.

    pages: PAGE, dpi, region_height, line_pitch_px. Without a pitch default_mm stands for it. The last tile is the first
    that reaches the region's end; strips lower than LEAST_TILE are left out.
    """
    pitch = F.coalesce(F.col("line_pitch_px"), geometry.mm_to_px(default_mm, F.col("dpi")).cast("double"))
    tall = F.floor(pitch * settings.tile_lines).cast("int")
    step = F.greatest(F.lit(1), tall - F.floor(pitch * settings.tile_overlap).cast("int"))
    rows = pages.select(*PAGE, F.col("region_height").alias("_height"), tall.alias("_tall"), step.alias("_step"))
    last = F.ceil(F.greatest(F.lit(0), F.col("_height") - F.col("_tall")) / F.col("_step")).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("tile")).withColumn("top", F.col("tile") * F.col("_step"))
    rows = rows.withColumn("bottom", F.least(F.col("_height"), F.col("top") + F.col("_tall")))
    return rows.where(F.col("bottom") - F.col("top") >= LEAST_TILE).select(*PAGE, "tile", "top", "bottom")


def of_tiles(found: DataFrame, pages: DataFrame, settings: Detection) -> DataFrame:
    """Candidates from all tiles of a page as one set: overlaps suppressed, then the margin filter.

    found: PAGE, tile, polygon (region pixels), detection_confidence. pages: PAGE, dpi, margin_rule_x, line_pitch_px,
    region_width.
    """
    boxed = found.withColumn("box", geometry.polygon_box(F.col("polygon")))
    order = Window.partitionBy(*PAGE).orderBy("tile", F.col("box")["y"], F.col("box")["x"], F.col("detection_confidence").desc(), F.col("polygon").cast("string"))
    boxed = boxed.withColumn("candidate_pos", F.row_number().over(order))
    kept = suppressed(boxed.join(pages.select(*PAGE, "region_width"), [*PAGE]).where(F.col("box")["x"] < F.col("region_width")), settings)
    kept = kept.join(boxed.select(*PAGE, "candidate_pos", "polygon"), [*PAGE, "candidate_pos"])
    facts = kept.join(pages.select(*PAGE, "dpi", "margin_rule_x", "line_pitch_px", "region_width"), [*PAGE])
    near = margin_filter(facts, F.col("dpi"), F.col("margin_rule_x"), F.col("line_pitch_px"), F.col("region_width"))
    return near.select(*PAGE, "candidate_pos", "box", "detection_confidence", "polygon")
