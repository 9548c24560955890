"""Readers: PDF folders, page decoding behind a plug-in, vocabularies, roles and calibration files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text
from quillstream.operators.vocabulary import VocabularyError
from quillstream.schema import VOCABULARY_ENTRIES


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, script_id, source_sha256, length, content): one file, or the PDFs right in a folder, in order of path."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "false")
    found = reader.load(path)
    return found.select("path", text.script_id(F.col("path")).alias("script_id"), F.sha2("content", 256).alias("source_sha256"), "length", "content").orderBy("path")


class PdfReadError(RuntimeError):
    """A file or a page cannot be read."""


class RetryableError(RuntimeError):
    """A failure that another attempt may not meet."""


#: A decoder gives the page count of a file's bytes, and a page: (BGR bytes, width, height, dpi, source).
Decoder = tuple[Callable[[bytes], int], Callable[[bytes, int, float], tuple[bytes, int, int, float, str]]]
DECODERS: dict[str, Decoder] = {}


def register_decoder(name: str, count: Callable[[bytes], int], load: Callable[[bytes, int, float], tuple]) -> None:
    DECODERS[name] = (count, load)


def page_numbers(files: DataFrame, decoder: str) -> DataFrame:
    """(script_id, page_index, content, error_code): a row for each page; an unreadable file has one row with its error."""
    count, _ = DECODERS[decoder]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, errors = [], []
            for content in batch["content"]:
                try:
                    n.append(count(bytes(content)))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  any decoder failure becomes a row
                    n.append(0)
                    errors.append(f"PDF_READ_ERROR: {error}")
            yield batch.assign(page_count=n, error_code=errors)

    counted = files.select("script_id", "content").mapInPandas(run, "script_id string, content binary, page_count int, error_code string")
    pages = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array(F.lit(0)))
    return counted.select("script_id", F.explode(pages).alias("page_index"), "content", "error_code")


def attempted(work: Callable[[], object], attempts: int, sleep: Callable[[float], None] = lambda s: None) -> tuple[object, str, str | None, str | None]:
    """(result, processing status, error code, reason): retryable and I/O failures are tried again, others end it."""
    for n in range(1, attempts + 1):
        try:
            return work(), "PROCESSED", None, None
        except (RetryableError, OSError) as error:
            last = error
            sleep(min(2.0, 0.2 * n))
        except PdfReadError as error:
            return None, "FAILED_PERMANENT", "PDF_READ_ERROR", str(error)
        except Exception as error:  # noqa: BLE001
            return None, "FAILED_PERMANENT", "UNEXPECTED_ERROR", str(error)
    return None, "FAILED_RETRYABLE", type(last).__name__.upper(), str(last)


def decoded(pages: DataFrame, decoder: str, render_dpi: float = 200.0, attempts: int = 2) -> DataFrame:
    """Pages with image, size, dpi and source, or a failure as columns. Call it on pages that are to be read only."""
    import time

    _, load = DECODERS[decoder]
    schema = "script_id string, page_index int, image binary, image_width int, image_height int, dpi double, image_source string, processing_status string, error_code string, error_reason string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                found, status, code, reason = attempted(lambda r=r: load(bytes(r.content), r.page_index, render_dpi), attempts, time.sleep)
                rows.append((r.script_id, r.page_index, *(found or (None, None, None, None, None)), status, code, reason))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return pages.select("script_id", "page_index", "content").mapInPandas(run, schema)


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """(script_id, page_index, content) of the images in a folder that are named <script>-P<number>, as PNG or PNM."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,ppm,pgm,PNG,PPM,PGM}").load(path)
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    rows = found.select(F.regexp_extract(stem, r"^(.*)-P\d+$", 1).alias("_script"), F.regexp_extract(stem, r"-P(\d+)$", 1).alias("_page"), "content")
    named = rows.where("_script <> '' and _page <> ''")
    return named.select(text.script_id(F.col("_script")).alias("script_id"), F.col("_page").cast("int").alias("page_index"), "content")


def _load_image(data: bytes, page_index: int, dpi: float) -> tuple[bytes, int, int, float, str]:
    from quillstream.image import codec, kernel

    try:
        image = kernel.normalised(codec.read(data))
    except codec.ImageError as error:
        raise PdfReadError(str(error)) from error
    return image.tobytes(), image.shape[1], image.shape[0], dpi, "image"


#: A file is one page; what it was scanned at is the render resolution of the settings.
register_decoder("image", lambda data: 1, _load_image)


def embedded_pages(objects: DataFrame, least_coverage: float) -> DataFrame:
    """Pages whose only image object covers enough of the page, upright and unmirrored.

    objects: script_id, page_index, a, b, c, d (matrix), coverage, px_width, left_pt, right_pt, depth.
    """
    near = objects.where("depth <= 2")
    alone = near.groupBy("script_id", "page_index").agg(F.count(F.lit(1)).alias("n"), *(F.first(x).alias(x) for x in ("a", "b", "c", "d", "coverage", "px_width", "left_pt", "right_pt")))
    fits = (F.col("n") == 1) & (F.abs("b") < 1e-6) & (F.abs("c") < 1e-6) & (F.col("a") > 0) & (F.col("d") > 0) & (F.col("coverage") >= least_coverage)
    dpi = F.bround(F.col("px_width") / ((F.col("right_pt") - F.col("left_pt")) / 72), 2)
    return alone.where(fits).select("script_id", "page_index", dpi.alias("dpi"))


def _entries(items: Iterable, where: str) -> list[tuple[str, bool | None]]:
    out = []
    for item in items:
        if isinstance(item, dict):
            explicit = item.get("target")
            if explicit is not None and not isinstance(explicit, bool):
                raise VocabularyError(f"target must be true or false: {item!r} in {where}")
            out.append((str(item.get("id", "")), explicit))
        else:
            out.append((str(item), None))
    return out


def vocabulary_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rules) of a YAML, JSON or TXT list on the driver. Its version is given or the content's digest."""
    import hashlib

    body = Path(path).read_text(encoding="utf-8")
    digest = "sha256:" + hashlib.sha256(body.encode()).hexdigest()[:12]
    kind = Path(path).suffix.lower()
    exam, version, rules = Path(path).stem, digest, {}
    if kind == ".txt":
        lines = (line.split("#")[0].strip() for line in body.splitlines())
        entries = [(x, None) for x in lines if x]
    elif kind in (".yaml", ".yml", ".json"):
        if kind == ".json":
            data = json.loads(body)
        else:
            import yaml

            data = yaml.safe_load(body)
        if not isinstance(data, dict) or "questions" not in data:
            raise VocabularyError("a list file must be a mapping with 'questions'")
        entries = _entries(data["questions"] or [], path)
        exam, version, rules = data.get("exam_id") or exam, str(data.get("version") or digest), data.get("answering_rules") or {}
    else:
        raise VocabularyError(f"unknown kind of list: {kind}")
    rows = [(exam, version, i, raw, explicit) for i, (raw, explicit) in enumerate(entries)]
    try:
        limits = [None if rules.get(k) is None else int(rules[k]) for k in ("min_answers", "max_answers")]
    except (TypeError, ValueError) as error:
        raise VocabularyError(f"answering rules: {error}") from error
    return spark.createDataFrame(rows, VOCABULARY_ENTRIES), spark.createDataFrame([(exam, *limits)], "exam_id string, min_answers int, max_answers int")


def vocabulary_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): identifiers of text lists in a store, a comment after # and blank lines dropped."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.trim(F.get(F.split("value", "#"), F.lit(0))).alias("raw"))
    return lines.where("raw <> ''")


def calibration_file(path: str) -> list[tuple[float, float]]:
    """Points of a JSON file, ascending, two at least, values that never fall."""
    points = sorted((float(x), float(y)) for x, y in json.loads(Path(path).read_text())["points"])
    return checked_points(points)


def checked_points(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    if len(points) < 2:
        raise ValueError("a calibration needs two points")
    if any(b < a for (_, a), (_, b) in zip(points, points[1:])):
        raise ValueError("calibrated values must not fall")
    return points
