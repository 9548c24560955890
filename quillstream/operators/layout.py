"""Landmarks from one-dimensional signals: clusters of rows, line pitch, the completed line grid, rule position, skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.config import Layout
from quillstream.functions import geometry


def clusters(df: DataFrame, keys: tuple[str, ...], value: str, gap: int = 3) -> DataFrame:
    """(keys, centre): the rounded means of runs of values whose neighbours are gap apart at most."""
    along = Window.partitionBy(*keys).orderBy(value)
    df = df.withColumn("_new", F.coalesce((F.col(value) - F.lag(value).over(along) > gap).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "_run").agg(F.bround(F.avg(value)).cast("int").alias("centre")).drop("_run")


def median_pitch(df: DataFrame, keys: tuple[str, ...], value: str, low: Column | float, high: Column | float, least: int = 3) -> DataFrame:
    """(keys, pitch): the median of neighbour distances within [low, high]; null with fewer than least of them."""
    apart = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(value))
    df = df.withColumn("_d", apart)
    df = df.withColumn("_d", F.when((F.col("_d") >= low) & (F.col("_d") <= high), F.col("_d")))
    return df.groupBy(*keys).agg(F.when(F.count("_d") >= least, F.percentile("_d", F.lit(0.5))).alias("pitch"))


#: What stays free below the last ruled line, in pitches. A fixed value.
BOTTOM_PITCHES = 0.3


def completed_grid(seen: Column, pitch: Column, settings: Layout, header: Column | None = None, height: Column | None = None) -> Column:
    """Line positions from the header, or else the first seen one: each step is a pitch, snapped to the nearest seen line
    within a share of it.

    seen ascends. The walk ends a tolerance beyond the last seen line, and BOTTOM_PITCHES above the page's bottom; it
    visits one position for each line. Null without header and lines.
    """
    tolerance = settings.snap_share * pitch
    none = F.lit(None).cast("int")
    begin = F.coalesce(header if header is not None else none, F.get(seen, F.lit(0))).cast("int")
    bottom = (height if height is not None else none) - BOTTOM_PITCHES * pitch
    last = F.least(F.when(F.size(seen) > 0, F.array_max(seen) + tolerance), bottom)
    start = F.struct(F.array(begin).alias("lines"), begin.cast("double").alias("at"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        expected = acc["at"] + pitch
        near = F.filter(seen, lambda v: F.abs(v - expected) <= tolerance)
        pick = F.array_min(F.transform(near, lambda v: F.struct(F.abs(v - expected).alias("d"), v.alias("v"))))["v"]
        value = F.coalesce(pick, F.bround(expected).cast("int"))
        done = acc["done"] | (expected > last)
        return F.struct(
            F.when(done, acc["lines"]).otherwise(F.concat(acc["lines"], F.array(value))).alias("lines"),
            F.when(done, acc["at"]).otherwise(F.coalesce(pick.cast("double"), expected)).alias("at"),
            done.alias("done"),
        )

    most = F.ceil((last - begin) / (pitch * (1 - settings.snap_share))).cast("int") + 2
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), start, step)["lines"]
    return F.when(begin.isNotNull() & last.isNotNull() & (pitch > 0), walked)


def ink_ratio(df: DataFrame, keys: tuple[str, ...], is_ink: Column) -> DataFrame:
    """(keys, ink): the share of a band's cells that are ink."""
    return df.groupBy(*keys).agg(F.avg(is_ink.cast("int")).alias("ink"))


def rule_position(df: DataFrame, keys: tuple[str, ...], at: str, value: str, width: int) -> DataFrame:
    """(keys, peak, centre): the first place of the largest moving sum of value, and the weighted centre around it."""
    half = width // 2
    around = Window.partitionBy(*keys).orderBy(at).rowsBetween(-half, width - 1 - half)
    df = df.withColumn("_sum", F.sum(value).over(around))
    df = df.withColumn("_moment", F.sum(F.col(value) * F.col(at)).over(around))
    best = F.max(F.struct(F.col("_sum"), (-F.col(at)).alias("early"), F.col("_moment")))
    out = df.groupBy(*keys).agg(best.alias("_b"))
    return out.select(*keys, (-F.col("_b.early")).alias("peak"), (F.col("_b._moment") / F.col("_b._sum")).alias("centre"))


def skew(df: DataFrame, keys: tuple[str, ...], x: str, y: str, least: int = 50) -> DataFrame:
    """(keys, skew_deg): the angle of the least-squares line x = a y + b; 0 with fewer points than least."""
    slope = F.regr_slope(x, y)
    return df.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= least, F.coalesce(F.degrees(F.atan(slope)), F.lit(0.0))).otherwise(0.0).alias("skew_deg"))


def parity(page_index: Column) -> Column:
    return F.when(page_index % 2 != 0, "odd").otherwise("even")


def to_canonical(layout: Column, m: Column) -> Column:
    """Rule at the height of the middle line, lines and header at the rule, all mapped by m and rounded."""
    lines = layout["ruled_line_ys"]
    rule = F.coalesce(layout["margin_rule_x"], F.lit(0))
    middle = F.coalesce(F.get(lines, F.floor(F.size(lines) / 2).cast("int")), F.lit(0))
    whole = lambda v: F.bround(v).cast("int")
    y_of = lambda y: whole(geometry.affine(m, rule, y)["y"])
    return F.struct(
        layout["found"].alias("found"),
        F.when(layout["margin_rule_x"].isNotNull(), whole(geometry.affine(m, layout["margin_rule_x"], middle)["x"])).alias("margin_rule_x"),
        F.when(layout["header_y"].isNotNull(), y_of(layout["header_y"])).alias("header_y"),
        F.transform(lines, y_of).alias("ruled_line_ys"),
        F.bround(layout["line_pitch_px"], 2).alias("line_pitch_px"),
        F.bround(layout["skew_deg"], 3).alias("skew_deg"),
    )


def content_class(components: Column, blank_max: int, sparse_max: int) -> Column:
    return F.when(components <= blank_max, "BLANK").when(components <= sparse_max, "SPARSE").otherwise("NORMAL")
