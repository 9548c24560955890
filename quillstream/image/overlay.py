"""A picture of what was found on a page: landmarks, marker boxes by status, and where answers begin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.image import codec, kernel

# Colours by status, in blue, green, red order.
COLOURS = {"ACCEPTED": (0, 160, 0), "REVIEW_REQUIRED": (0, 140, 255), "UNRESOLVED": (0, 0, 255), "DISCARDED": (160, 160, 160), "REJECTED": (120, 120, 120)}
RULE, LINE, VALUER = (255, 0, 255), (255, 200, 0), (200, 0, 200)


def _fill(image: np.ndarray, x0: float, y0: float, x1: float, y1: float, colour: tuple[int, int, int]) -> None:
    image[max(0, int(y0)) : max(0, int(y1)), max(0, int(x0)) : max(0, int(x1))] = colour


def frame(image: np.ndarray, x: int, y: int, width: int, height: int, colour: tuple[int, int, int], thick: int) -> None:
    """The outline of a box, thick pixels wide and centred on its edge."""
    a, b = thick // 2, thick - thick // 2
    _fill(image, x - a, y - a, x + width + b, y + b, colour)
    _fill(image, x - a, y + height - a, x + width + b, y + height + b, colour)
    _fill(image, x - a, y - a, x + b, y + height + b, colour)
    _fill(image, x + width - a, y - a, x + width + b, y + height + b, colour)


def drawn(image: np.ndarray, layout: dict | None, valuers: list, markers: list[dict]) -> np.ndarray:
    """A copy of a page, half as large, with everything drawn on it. Rows of markers as markers.assembled names them."""
    out = image.copy()
    if layout:
        lines = layout.get("ruled_line_ys")
        for y in () if lines is None else lines:
            _fill(out, 0, y, out.shape[1], y + 1, LINE)
        if layout.get("margin_rule_x") is not None:
            _fill(out, layout["margin_rule_x"] - 1, 0, layout["margin_rule_x"] + 1, len(out), RULE)
    for x, y, w, h in valuers:
        frame(out, x, y, w, h, VALUER, 1)
    for m in markers:
        colour = COLOURS.get(m["status"], (0, 0, 0))
        frame(out, m["marker_x"], m["marker_y"], m["marker_width"], m["marker_height"], colour, 1 if m["status"] == "DISCARDED" else 3)
        if m["status"] != "DISCARDED" and m.get("question_start_x") is not None and m.get("question_start_y") is not None:
            x, y = int(m["question_start_x"]), int(m["question_start_y"])
            ys, xs = np.mgrid[0 : out.shape[0], 0 : out.shape[1]][:, max(0, y - 14) : y + 15, max(0, x - 14) : x + 15]
            ring = np.abs(np.hypot(xs - x, ys - y) - 12) <= 1.5
            out[ys[ring], xs[ring]] = colour
            steps = np.linspace(0, 1, 2 * max(out.shape))[:, None]
            begin = np.array([m["marker_x"] + m["marker_width"], m["marker_y"] + m["marker_height"] // 2])
            line = np.rint(begin + steps * (np.array([x, y]) - begin)).astype(int)
            inside = (line >= 0).all(1) & (line[:, 0] < out.shape[1]) & (line[:, 1] < out.shape[0])
            out[line[inside, 1], line[inside, 0]] = colour
    return np.rint(kernel.block_mean(out, 2)).astype(np.uint8)


def pictures(decoded: DataFrame, facts: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, data): a PNG for each page that has facts, below its script's folder, for sinks.write_images."""
    page = ["script_id", "page_index"]
    named = ("status", "marker_x", "marker_y", "marker_width", "marker_height", "question_start_x", "question_start_y")
    rows = markers.groupBy(*page).agg(F.collect_list(F.struct(*named)).alias("markers"))
    shapes = facts.select(*page, F.struct("margin_rule_x", "ruled_line_ys").alias("layout"), "valuer_boxes")
    whole = decoded.select(*page, "image", "image_width", "image_height").join(shapes, page).join(rows, page, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples():
                image = np.frombuffer(r.image, np.uint8).reshape(r.image_height, r.image_width, 3)
                own = [] if r.markers is None else [dict(m) if isinstance(m, dict) else m.asDict() for m in r.markers]
                layout = r.layout if isinstance(r.layout, dict) or r.layout is None else r.layout.asDict()
                picture = drawn(image, layout, [] if r.valuer_boxes is None else [list(b) for b in r.valuer_boxes], own)
                yield pd.DataFrame([(f"{r.script_id}/overlays/page_{r.page_index:03d}.png", codec.png(picture))], columns=["path", "data"])

    return whole.mapInPandas(run, "path string, data binary")
