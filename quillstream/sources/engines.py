"""Recognisers and text detectors behind an interface, in batches, one model for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillstream.image import codec

#: A maker is called once in a worker; what it makes takes a list of encoded crops and gives (text, confidence) for each.
Recogniser = Callable[[list[bytes]], list[tuple[str, float]]]
ENGINES: dict[str, Callable[..., Recogniser]] = {}


def register_engine(name: str, maker: Callable[..., Recogniser]) -> None:
    ENGINES[name] = maker


def scripted(texts: dict[bytes, tuple[str, float]] | None = None) -> Recogniser:
    """Looks crops up in a table; for tests and replays."""
    known = texts or {}
    return lambda crops: [known.get(c, ("", 0.0)) for c in crops]


register_engine("scripted", scripted)


def recognised(crops: DataFrame, engine: str, batch: int = 8, **options: object) -> DataFrame:
    """crops (script_id, page_index, candidate_pos, crop) with raw and recognition_confidence.

    The recogniser must answer for every crop of a batch; a wrong count is an error, not a silent cut.
    """
    maker = ENGINES[engine]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = maker(**options)
        for df in batches:
            found: list[tuple[str, float]] = []
            images = [bytes(c) for c in df["crop"]]
            for i in range(0, len(images), batch):
                part = model(images[i : i + batch])
                if len(part) != len(images[i : i + batch]):
                    raise ValueError("the recogniser must give one text for each crop")
                found += part
            keys = df[["script_id", "page_index", "candidate_pos"]]
            yield keys.assign(raw=[t for t, _ in found], recognition_confidence=[float(c) for _, c in found])

    return crops.mapInPandas(run, "script_id string, page_index int, candidate_pos int, raw string, recognition_confidence double")


#: A maker is called once in a worker; what it makes takes a gray image and gives (polygon, confidence) for each text in it.
Detector = Callable[["np.ndarray"], list[tuple[list[list[float]], float]]]
DETECTORS: dict[str, Callable[..., Detector]] = {}


def register_detector(name: str, maker: Callable[..., Detector]) -> None:
    DETECTORS[name] = maker


def scripted_detector(found: list[tuple[list[list[float]], float]] | None = None) -> Detector:
    """The same polygons for every tile that they fit in; for tests and replays."""
    return lambda tile: [(p, c) for p, c in found or [] if max(y for _, y in p) <= tile.shape[0]]


register_detector("scripted", scripted_detector)

DETECTIONS = "script_id string, page_index int, tile int, polygon array<array<double>>, detection_confidence double"


def detected(tiles: DataFrame, detector: str, **options: object) -> DataFrame:
    """DETECTIONS for tiles (script_id, page_index, tile, top, bottom, region): polygons in pixels of the region.

    A tile is padded with white on its right, as wide as itself, since detectors want images that are not too narrow.
    """
    maker = DETECTORS[detector]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = maker(**options)
        for df in batches:
            rows = []
            for r in df.itertuples():
                part = codec.read(bytes(r.region))[r.top : r.bottom]
                part = np.pad(part, ((0, 0), (0, part.shape[1])), constant_values=255)
                rows += [(r.script_id, r.page_index, r.tile, [[float(x), float(y + r.top)] for x, y in p], float(c)) for p, c in model(part)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")])

    return tiles.select("script_id", "page_index", "tile", "top", "bottom", "region").mapInPandas(run, DETECTIONS)
