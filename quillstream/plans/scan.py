"""From images of pages to observations: page facts, candidates, crops, and the texts that a recogniser reads in them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.config import Settings
from quillstream.functions import geometry
from quillstream.image import codec, kernel
from quillstream.operators import detect, layout
from quillstream.operators.detect import PAGE
from quillstream.schema import BOX
from quillstream.sources import engines

DECODED = (*PAGE, "image", "image_width", "image_height", "dpi", "processing_status")


def page_facts(decoded: DataFrame, settings: Settings) -> DataFrame:
    """Facts of decoded pages (DECODED), one row for each; kernel.SCHEMA, dpi and layout. Failed pages have none."""
    read = decoded.where("processing_status = 'PROCESSED'").select(*PAGE, F.col("image").alias("data"), "image_width", "image_height", "dpi")
    shape = F.struct("found", "margin_rule_x", "header_y", "ruled_line_ys", "line_pitch_px")
    content = layout.content_class(F.col("components"), settings.triage.blank_max, settings.triage.sparse_max)
    # only scalars, the strip and not the page go on
    return kernel.analysed(read, settings).join(read.select(*PAGE, "dpi"), [*PAGE]).withColumn("layout", shape).withColumn("content_class", content)


def components(facts: DataFrame, settings: Settings) -> DataFrame:
    """Candidates from connected components: filtered, merged by line or by overlap, filtered again."""
    c = F.col("_c")
    rows = facts.select(*PAGE, "dpi", "margin_rule_x", "ruled_line_ys", F.posexplode("candidates").alias("candidate_pos", "_c"))
    rows = rows.withColumn("box", geometry.box(c[0], c[1], c[2], c[3])).withColumn("area", c[4].cast("double"))
    rows = detect.component_filter(rows, F.col("dpi"), settings.detection, F.col("margin_rule_x"))
    rows = rows.withColumn("band", geometry.band_index(geometry.centre_y(F.col("box")), F.col("ruled_line_ys")))
    rows = rows.withColumn("detection_confidence", F.lit(1.0)).withColumn("polygon", F.lit(None).cast("array<array<double>>"))
    gap = geometry.mm_to_px(settings.detection.merge_gap_mm, F.col("dpi"))
    ruled = detect.merge_by_line(rows.where("band is not null").withColumn("_gap", gap), F.col("_gap")).select(*PAGE, "box", "detection_confidence")
    plain = detect.merge_by_overlap(rows.where("band is null"), gap).select(*PAGE, "box", "detection_confidence")
    ruled = ruled.unionByName(plain)
    merged = detect.merged_filter(ruled.join(facts.select(*PAGE, "dpi"), [*PAGE]), F.col("dpi"), settings.detection)
    return merged.select(*PAGE, "box", "detection_confidence", F.lit(None).cast("array<array<double>>").alias("polygon"))


def detections(facts: DataFrame, settings: Settings, detector: str, **options: object) -> DataFrame:
    """Candidates from a text detector that reads the margin in tiles, in page pixels."""
    size = facts.select(*PAGE, "dpi", "margin_rule_x", "line_pitch_px", "region", "region_top", F.size("candidates").alias("_n"), "image_height")
    pages = _region_sizes(size)
    cut = detect.tiles(pages, settings.detection).join(pages.select(*PAGE, "region"), [*PAGE])
    found = detect.of_tiles(engines.detected(cut, detector, **options), pages, settings.detection).join(pages.select(*PAGE, "region_top"), [*PAGE])
    b, down = F.col("box"), F.col("region_top")
    moved = F.transform("polygon", lambda p: F.array(p[0], p[1] + down))
    return found.select(*PAGE, geometry.box(b["x"], b["y"] + down, b["width"], b["height"]).alias("box"), "detection_confidence", moved.alias("polygon"))


def _region_sizes(pages: DataFrame) -> DataFrame:
    """pages with region_width and region_height, which a PNG says in its bytes 16 to 23."""
    whole = lambda at: F.conv(F.hex(F.substring("region", at, 4)), 16, 10).cast("int")
    return pages.withColumn("region_width", whole(17)).withColumn("region_height", whole(21))


def crops(candidates: DataFrame, facts: DataFrame, settings: Settings) -> DataFrame:
    """(PAGE, candidate_pos, box, detection_confidence, polygon, crop) for candidates, numbered by (y, x)."""
    schema = f"script_id string, page_index int, candidate_pos int, box {BOX}, detection_confidence double, polygon array<array<double>>, crop binary"
    names = ("candidate_pos", "box", "detection_confidence", "polygon")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples():  # a page
                margin, rows = codec.read(bytes(r.region)), []
                for one in r.found:
                    b = one["box"]
                    cut = kernel.crop(margin, (b["x"], b["y"] - r.region_top, b["width"], b["height"]), r.dpi, settings.detection.padding_mm)
                    rows.append((r.script_id, r.page_index, *(one[n] for n in names), codec.png(cut)))
                yield pd.DataFrame(rows, columns=["script_id", "page_index", *names, "crop"])

    numbered = detect.numbered(candidates.withColumn("candidate_pos", F.lit(0))).withColumn("candidate_pos", F.col("number"))
    # a page's few candidates stand in one row, beside its strip
    pages = numbered.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("found"))
    rows = pages.join(facts.select(*PAGE, "dpi", "region", "region_top"), [*PAGE])
    return rows.select(*PAGE, "found", "dpi", "region", "region_top").mapInPandas(run, schema)


def observations(facts: DataFrame, settings: Settings, engine: str, exam_id: str, detector: str = "scripted", engine_options: dict | None = None, detector_options: dict | None = None) -> DataFrame:
    """What markers.classified reads, for pages with facts: every candidate with its text and confidence."""
    if settings.detection.method == "margin_components":
        found = components(facts, settings)
    elif settings.detection.method == "text_detector":
        found = detections(facts, settings, detector, **(detector_options or {}))
    else:
        raise ValueError(f"unknown detection method: {settings.detection.method}")
    cut = crops(found, facts, settings)
    texts = engines.recognised(cut, engine, **(engine_options or {}))
    keys = [*PAGE, "candidate_pos"]
    return cut.drop("crop").join(texts, keys).withColumn("exam_id", F.lit(exam_id))


def misplaced(facts: DataFrame, templates: DataFrame, most: int = 10) -> DataFrame:
    """(PAGE, page_role, distance, is_misplaced): pages whose hash is far from the template's of their role.

    facts: PAGE, page_role, template_hash. templates: page_role, template_hash, a row or more for each printed page; the
    nearest counts. A role without a template is never misplaced.
    """
    known = F.broadcast(templates.select("page_role", F.col("template_hash").alias("_known")))  # the few printed pages of a booklet
    near = facts.join(known, "page_role", "left").withColumn("_d", F.bit_count(F.col("template_hash").bitwiseXOR(F.col("_known"))))
    out = near.groupBy(*PAGE, "page_role").agg(F.min("_d").alias("distance"))
    return out.withColumn("is_misplaced", F.coalesce(F.col("distance") > most, F.lit(False)))
