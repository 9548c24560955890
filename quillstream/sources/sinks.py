"""Writers: result tables and JSON documents replaced by script and version, image files, and the run manifest."""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillstream.config import Settings

KEYS = ("processing_version", "script_bucket")
#: Folders of a stored version, however many scripts there are.
BUCKETS = 256


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("script_bucket", F.pmod(F.xxhash64("script_id"), F.lit(buckets)).cast("int"))


def _stored(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where) and any(x.isDirectory() for x in files.listStatus(where))


def replace_scripts(df: DataFrame, path: str, order: tuple[str, ...] = (), buckets: int = BUCKETS, document: str | None = None) -> None:
    """Replaces what path holds of the scripts and versions in df; everything else in it stays.

    df has script_id and processing_version. document: path holds lines of text, this column, which are JSON with
    script_id; otherwise Parquet. Scripts are hashed into buckets, and a bucket is written anew: what it held
    of other scripts is carried over. A reader sees a bucket as it was or as it is, by the job's commit; a rerun after a
    failure gives the same files. Two runs must not write to one path at a time.
    """
    spark = df.sparkSession
    rows = _bucketed(df, buckets)
    if _stored(spark, path):
        old = spark.read.parquet(path) if document is None else spark.read.text(path).withColumnRenamed("value", document)
        old = old if document is None else old.withColumn("script_id", F.get_json_object(document, "$.script_id"))
        old = old.withColumn("processing_version", F.col("processing_version").cast("string"))
        touched = F.broadcast(rows.select(*KEYS).distinct())  # a version's buckets at most
        mine = rows.select("processing_version", "script_id").distinct()
        others = old.join(touched, [*KEYS], "left_semi").join(mine, ["processing_version", "script_id"], "left_anti")
        rows = rows.unionByName(others, allowMissingColumns=True)
    rows = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "script_id", *order)
    rows = rows if document is None else rows.select(document, *KEYS)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS)
    writer.parquet(path) if document is None else writer.text(path)


def write_markers(markers: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Marker rows of scripts, replacing what was stored of them under the same version."""
    replace_scripts(markers, path, ("page_index", "marker_y"), buckets)


def script_documents(pages: DataFrame, markers: DataFrame, flags: DataFrame) -> DataFrame:
    """(script_id, document): one JSON text for each script, pages and their markers nested."""
    rows = markers.groupBy("script_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("marker_y", "candidate_pos", F.to_json(F.struct(*[c for c in markers.columns if c not in ("script_id", "page_index")])).alias("m")))).alias("markers"))
    full = pages.join(rows, ["script_id", "page_index"], "left")
    page = F.to_json(F.struct(*[c for c in pages.columns if c != "script_id"]))
    body = F.concat(F.expr("substring(_page, 1, length(_page) - 1)"), F.lit(',"markers":['), F.array_join(F.transform(F.coalesce("markers", F.array().cast(rows.schema["markers"].dataType)), lambda x: x["m"]), ","), F.lit("]}"))
    joined = full.withColumn("_page", page).select("script_id", "page_index", body.alias("p")).groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct("page_index", "p"))).alias("pages"))
    text = F.concat(F.lit('{"script_id":"'), F.col("script_id"), F.lit('","flags":'), F.to_json("flags"), F.lit(',"flag_details":'), F.to_json("flag_details"), F.lit(',"pages":['), F.array_join(F.transform("pages", lambda x: x["p"]), ","), F.lit("]}"))
    return joined.join(flags, "script_id", "left").select("script_id", text.alias("document"))


def write_documents(documents: DataFrame, path: str, version: str) -> None:
    """One JSON text for each script, replacing what was stored of it under the same version."""
    replace_scripts(documents.select("script_id", "document", F.lit(version).alias("processing_version")), path, document="document")


def write_images(images: DataFrame, folder: str) -> None:
    """Writes (path, data) as files below a folder that all executors reach; a file is there whole or not at all.

    Bytes are written as they are: an original image stays untouched.
    """

    def run(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for r in rows:
            where = f"{root}/{r['path']}"
            files.create_dir(where.rsplit("/", 1)[0], recursive=True)
            part = f"{where}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(part) as out:
                out.write(bytes(r["data"]))
            files.move(part, where)

    images.select("path", "data").foreachPartition(run)


def run_manifest(spark: SparkSession, settings: Settings, engine: object, calibrated: bool, seconds: float) -> DataFrame:
    """One row about a run: versions, engine, whether confidences are calibrated, all settings, and its time."""
    row = (settings.processing_version(), json.dumps(dataclasses.asdict(engine)), calibrated, json.dumps(dataclasses.asdict(settings), default=str), float(seconds))
    return spark.createDataFrame([row], "processing_version string, engine string, calibrated boolean, settings string, seconds double")
