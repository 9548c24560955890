"""The whole path from observations on pages to marker rows, in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream import __version__
from quillstream.config import Settings
from quillstream.functions import distance, geometry, text
from quillstream.operators import gate, grammar, read, start

PREPROCESSING_VERSION = f"quillstream-{__version__}/layout-1/ink-1"
PARSER_VERSION = f"quillstream-{__version__}"


@dataclass(frozen=True)
class Engine:
    """Where the texts come from; carried into every marker row."""

    name: str = "scripted"
    model: str = "none"
    version: str = "0"


def with_roles(pages: DataFrame, settings: Settings) -> DataFrame:
    """pages with page_role from the booklet's map, its default elsewhere."""
    roles = [F.lit(x) for pair in settings.booklet.page_roles.items() for x in pair]
    found = F.try_element_at(F.create_map(*roles), F.col("page_index")) if roles else F.lit(None).cast("string")
    return pages.withColumn("page_role", F.coalesce(found, F.lit(settings.booklet.default_role)))


def pruned(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages to decode, rows for the others). The split stands before any Python, so excluded pages are never decoded."""
    out = pages.where("page_role <> 'ANSWER'")
    return pages.where("page_role = 'ANSWER'"), out.withColumn("processing_status", F.lit("SKIPPED_BY_ROLE")).withColumn("content_class", F.lit("TEMPLATE"))


def classified(observations: DataFrame, pages: DataFrame, vocabulary: DataFrame, settings: Settings, calibration: list | None = None) -> DataFrame:
    """observations with all columns of parsing, resolution, start and gate.

    observations: script_id, exam_id, page_index, candidate_pos, raw, recognition_confidence, box, detection_confidence.
    pages: script_id, page_index, dpi, is_colour, layout, band_ink. Rows whose page is unknown are left out.
    """
    layout = F.col("layout")
    facts = pages.select("script_id", "page_index", "dpi", "is_colour", layout.alias("_layout"), "band_ink")
    df = observations.join(facts, ["script_id", "page_index"])
    df = (
        df.withColumn("margin_rule_x", F.col("_layout.margin_rule_x"))
        .withColumn("ruled_line_ys", F.coalesce("_layout.ruled_line_ys", F.array().cast("array<int>")))
        .withColumn("landmarks_found", F.coalesce("_layout.found", F.lit(False)))
        .drop("_layout")
    )
    df = df.withColumn("y", F.col("box")["y"]).withColumn("height", F.col("box")["height"])
    df = df.withColumn("band", geometry.band_index(geometry.centre_y(F.col("box")), F.col("ruled_line_ys")))
    inside, valid = gate.position(F.col("box")["x"], F.col("box")["width"], F.col("margin_rule_x"), gate.spill(F.col("dpi"), settings.region))
    df = df.withColumn("position_valid", valid).withColumn("_inside", inside)
    df = df.withColumn("recognition_confidence_raw", F.col("recognition_confidence"))
    df = df.withColumn("recognition_confidence", distance.calibrated(F.col("recognition_confidence_raw"), calibration or []))
    df = read.read(df, vocabulary, settings, grammar.at_edge(F.col("box")["x"], F.col("dpi")))
    odd = gate.implausible(F.coalesce("raw", F.lit("")), F.col("box")["width"], F.col("box")["height"], settings.detection)
    df = df.withColumn("discard_reason", gate.discarded(F.col("_inside"), F.col("kind"), odd)).drop("_inside")
    df = gate.header_tokens(df, settings.grammar)
    df = start.next_band(df.withColumn("discard_reason", F.when(F.col("is_header"), "HEADER_TOKEN").otherwise(F.col("discard_reason"))))
    df = df.withColumn("flags", text.in_order_once(F.col("parse_flags"), F.coalesce("resolution_flags", F.array().cast("array<string>"))))
    return gate.decide(start.search(df, settings.start), settings.gate)


def assembled(rows: DataFrame, pages: DataFrame, settings: Settings, engine: Engine = Engine(), list_version: str = "unversioned") -> DataFrame:
    """Marker rows in canonical coordinates with their provenance.

    pages: script_id, page_index, image_width, image_height, work_to_canonical (six numbers).
    """
    version = F.lit(settings.processing_version())
    df = rows.join(pages.select("script_id", "page_index", "image_width", "image_height", "work_to_canonical"), ["script_id", "page_index"])
    c, m = F.col, F.col("work_to_canonical")
    outline = geometry.mapped_polygon(m, F.coalesce("polygon", geometry.corners(c("box")).cast("array<array<double>>")) if "polygon" in rows.columns else geometry.corners(c("box")))
    df = df.withColumn("box_c", geometry.clamp(geometry.polygon_box(geometry.mapped_polygon(m, geometry.corners(c("box")))), c("image_width"), c("image_height")))
    begin = geometry.affine(m, c("start_x"), c("start_y"))
    live = c("discard_reason").isNull()
    page = text.page_id(c("script_id"), c("page_index"))
    return df.select(
        geometry.marker_id(c("script_id"), page, version, c("band"), c("box_c"), c("dpi")).alias("marker_result_id"),
        "script_id", "exam_id", page.alias("page_id"), "page_index", "candidate_pos", version.alias("processing_version"), c("band").alias("line_index"),
        c("raw").alias("raw_ocr_text"), c("parsed_text").alias("parsed_marker"), F.coalesce("matched_key", F.when(F.size("segments") > 0, text.key(c("segments")))).alias("normalized_marker"),
        "question", F.coalesce("candidates", F.array().cast("array<struct<question_id:string,score:double>>")).alias("candidate_list"), c("method").alias("resolution_method"), c("flags").alias("parse_flags"),
        F.bround("detection_confidence", 4).alias("detection_confidence"), F.bround("recognition_confidence", 4).alias("recognition_confidence"),
        F.bround("recognition_confidence_raw", 4).alias("recognition_confidence_raw"), F.bround("resolution_confidence", 4).alias("resolution_confidence"),
        F.bround("resolution_margin", 4).alias("resolution_margin"), "image_width", "image_height", "dpi", outline.alias("marker_polygon"),
        c("box_c.x").alias("marker_x"), c("box_c.y").alias("marker_y"), c("box_c.width").alias("marker_width"), c("box_c.height").alias("marker_height"),
        F.when(live, F.bround(begin["x"]).cast("int")).alias("question_start_x"), F.when(live, F.bround(begin["y"]).cast("int")).alias("question_start_y"),
        F.when(live, c("start_method")).alias("question_start_method"), F.when(live, F.bround("start_confidence", 3)).alias("question_start_confidence"),
        "status", "review_reasons", "discard_reason", F.lit(engine.name).alias("ocr_engine"), F.lit(engine.model).alias("ocr_model"), F.lit(engine.version).alias("ocr_model_version"),
        F.lit(PREPROCESSING_VERSION).alias("preprocessing_version"), F.lit(settings.grammar.version).alias("grammar_version"), F.lit(PARSER_VERSION).alias("parser_version"),
        F.lit(list_version).alias("question_list_version"), version.alias("config_version"), F.lit("AUTOMATIC").alias("source"),
    )


def effective(markers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Beyond the automatic rows: a human's latest row wins, and a later automatic value that differs is a conflict.

    reviews: marker_result_id, action, corrected (map), reviewed_at. A corrected question replaces the automatic one.
    """
    last = Window.partitionBy("marker_result_id").orderBy(F.col("reviewed_at").desc(), "action")
    human = reviews.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("marker_result_id", "action", F.try_element_at("corrected", F.lit("question")).alias("_question"))
    df = markers.join(human, "marker_result_id", "left")
    conflict = (F.col("action") == "CORRECT") & ~F.col("_question").eqNullSafe(F.col("question"))
    status = F.when(F.col("action") == "REJECT", "REJECTED").when(F.col("action").isin("CONFIRM", "CORRECT", "ADD"), "ACCEPTED").otherwise(F.col("status"))
    return (
        df.withColumn("review_reasons", F.when(F.coalesce(conflict, F.lit(False)), text.in_order_once(F.col("review_reasons"), F.array(F.lit("HUMAN_VS_REPROCESS_CONFLICT")))).otherwise(F.col("review_reasons")))
        .withColumn("question", F.when(F.col("action") == "CORRECT", F.col("_question")).otherwise(F.col("question")))
        .withColumn("status", status)
        .withColumn("source", F.when(F.col("action") == "CORRECT", "REVIEWER_CORRECTED").when(F.col("action") == "ADD", "REVIEWER_ADDED").otherwise(F.col("source")))
        .drop("action", "_question")
    )
