"""Deterministic stand-ins for page observations, made from relational tables, with the same projections as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import geometry
from quillstream.operators import vocabulary
from quillstream.schema import VOCABULARY_ENTRIES

DPI = 200.0
#: Identifiers that stand-in texts are resolved against; two of them have the same characters.
IDENTIFIERS = ("1", "2", "3", "4", "5", "6", "7", "8", "11", "12", "1(1)", "20(a)", "20(b)", "20(b)(ii)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identifiers(spark: SparkSession) -> DataFrame:
    rows = [("EXAM", "1", i, x, None) for i, x in enumerate(IDENTIFIERS)]
    return vocabulary.build(spark.createDataFrame(rows, VOCABULARY_ENTRIES))


#: Forms of stand-in texts, picked by l_partkey % 12: six plain ones of head, number and tail, and six odd ones.
_HEADS = ("Ans ", "Q.No ", "s ", "", "Section ", "QNo")
_TAILS = (")", ".", "", " From")
_SUBS = ("(b)(1)", "(ii)", "-a", "(a) (xii)", ".1.2", " or 7", "(b)(ii)", "[c]iv")
_LONE = ("Q", "Ans", "Section", "Name", "---", "", "Q.No.", "xQ")
_BEYOND = ("é ", "→", "“", "日 ")
_MISREAD = ("l", "O", "I", "S", "z")


def _pick(values: tuple[str, ...], at: str):
    return F.get(F.array(*map(F.lit, values)), F.col(at) % len(values))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from lineitem: a page for each order."""
    df = table(spark, sf_dir, "lineitem")
    form, number = F.col("l_partkey") % 12, (F.col("l_partkey") % 60).cast("string")
    raw = (
        F.when(form == 6, F.concat(number, _pick(_SUBS, "l_suppkey")))
        .when(form == 7, _pick(_LONE, "l_suppkey"))
        .when(form == 8, F.concat((F.col("l_partkey") * 37 % 100_000).cast("string"), _pick(_TAILS, "l_suppkey")))
        .when(form == 9, F.concat(_pick(_BEYOND, "l_suppkey"), number))
        .when(form == 10, F.concat(F.lit("1"), number, F.lit("(a)")))
        .when(form == 11, F.concat((F.col("l_partkey") % 6).cast("string"), _pick(_MISREAD, "l_suppkey"), F.lit("(b)")))
        .otherwise(F.concat(_pick(_HEADS, "l_orderkey"), number, _pick(_TAILS, "l_suppkey")))
    )
    return df.select(
        F.concat(F.lit("S"), (F.col("l_orderkey") % 500).cast("string")).alias("script_id"),
        F.lit("EXAM").alias("exam_id"),
        F.expr("int(l_orderkey div 500)").alias("page_index"),
        (F.col("l_linenumber") * 100_000 + F.col("l_partkey") % 100_000).cast("int").alias("candidate_pos"),
        raw.alias("raw"),
        ((60 + F.col("l_orderkey") % 41) / F.lit(100.0)).alias("recognition_confidence"),
        geometry.box((F.col("l_partkey") % 3) * 5, 235 + 74 * F.col("l_linenumber") + F.col("l_partkey") % 7, 20 + F.col("l_partkey") % 80, 30 + F.col("l_suppkey") % 50).alias("box"),
        ((50 + F.col("l_suppkey") % 50) / F.lit(100.0)).alias("detection_confidence"),
    )


def _picked(values: tuple[str, ...], at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({at} % {len(values)} + 1)::INT]"


LINES = f"""
lines AS (
  SELECT 'S' || (l_orderkey % 500) AS script_id, 'EXAM' AS exam_id, (l_orderkey // 500)::INT AS page_index, (l_linenumber * 100000 + l_partkey % 100000)::INT AS candidate_pos,
    CASE l_partkey % 12 WHEN 6 THEN (l_partkey % 60) || {_picked(_SUBS, "l_suppkey")} WHEN 7 THEN {_picked(_LONE, "l_suppkey")} WHEN 8 THEN (l_partkey * 37 % 100000) || {_picked(_TAILS, "l_suppkey")}
      WHEN 9 THEN {_picked(_BEYOND, "l_suppkey")} || (l_partkey % 60) WHEN 10 THEN '1' || (l_partkey % 60) || '(a)' WHEN 11 THEN (l_partkey % 6) || {_picked(_MISREAD, "l_suppkey")} || '(b)'
      ELSE {_picked(_HEADS, "l_orderkey")} || (l_partkey % 60) || {_picked(_TAILS, "l_suppkey")} END AS raw,
    (60 + l_orderkey % 41) / 100.0::DOUBLE AS recognition_confidence,
    ((l_partkey % 3) * 5)::INT AS x, (235 + 74 * l_linenumber + l_partkey % 7)::INT AS y, (20 + l_partkey % 80)::INT AS width, (30 + l_suppkey % 50)::INT AS height,
    (50 + l_suppkey % 50) / 100.0::DOUBLE AS detection_confidence
  FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from events: a page for each user."""
    df = table(spark, sf_dir, "events")
    return df.select(
        F.concat(F.lit("U"), (F.col("user_id") % 50).cast("string")).alias("script_id"),
        F.col("user_id").cast("int").alias("page_index"),
        F.col("event_id").cast("int").alias("candidate_pos"),
        geometry.box(F.col("event_id") % 150, F.col("event_id") % 97 * 20, 1 + F.col("event_id") % 41, 1 + F.col("event_id") % 31).alias("box"),
        ((1 + F.col("event_id") % 41) * (1 + F.col("event_id") % 31) * F.lit(0.5)).alias("area"),
        ((50 + F.col("event_id") % 47) / F.lit(100.0)).alias("detection_confidence"),
        F.lit(None).cast("array<array<double>>").alias("polygon"),
        (F.col("event_id") % 5).cast("int").alias("band"),
    )


BOXES = """
boxes AS (
  SELECT 'U' || (user_id % 50) AS script_id, user_id::INT AS page_index, event_id::INT AS candidate_pos,
    (event_id % 150)::INT AS x, (event_id % 97 * 20)::INT AS y, (1 + event_id % 41)::INT AS width, (1 + event_id % 31)::INT AS height,
    ((1 + event_id % 41) * (1 + event_id % 31) * 0.5)::DOUBLE AS area, (50 + event_id % 47) / 100.0::DOUBLE AS detection_confidence, (event_id % 5)::INT AS band
  FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled markers from conversations: a script for each conversation, a page for each turn."""
    df = table(spark, sf_dir, "conversations")
    size = F.length(F.coalesce("text", F.lit("")))
    return df.select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("script_id"),
        F.lit("EXAM").alias("exam_id"),
        F.col("turn").cast("int").alias("page_index"),
        F.lit(0).alias("candidate_pos"),
        (size % 100).cast("int").alias("marker_y"),
        F.when(size % 9 < 8, (size % 8 + 1).cast("string")).alias("question"),
        F.get(F.array(*map(F.lit, ("ACCEPTED", "REVIEW_REQUIRED", "UNRESOLVED", "ACCEPTED"))), (size % 4).cast("int")).alias("status"),
        F.array().cast("array<string>").alias("review_reasons"),
    )


TURNS = """
turns AS (
  SELECT 'C' || conv_id AS script_id, 'EXAM' AS exam_id, turn::INT AS page_index, 0 AS candidate_pos, (length(coalesce(text, '')) % 100)::INT AS marker_y,
    CASE WHEN length(coalesce(text, '')) % 9 < 8 THEN (length(coalesce(text, '')) % 8 + 1)::VARCHAR END AS question,
    ['ACCEPTED', 'REVIEW_REQUIRED', 'UNRESOLVED', 'ACCEPTED'][(length(coalesce(text, '')) % 4 + 1)::INT] AS status
  FROM conversations),
places AS (SELECT unnest(['1', '2', '3', '4', '5', '6', '7', '8']) AS question, unnest(range(8)) AS ord),
ordered AS (
  SELECT t.*, p.ord, row_number() OVER (PARTITION BY script_id ORDER BY page_index, marker_y, candidate_pos) - 1 AS seq
  FROM turns t LEFT JOIN places p USING (question)
  WHERE status IN ('ACCEPTED', 'REVIEW_REQUIRED') AND question IS NOT NULL)"""


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from documents: a script for ten of them."""
    df = table(spark, sf_dir, "documents")
    size = F.length(F.coalesce("text", F.lit("")))
    role = F.when(F.col("doc_id") % 10 == 0, "COVER").when(F.col("doc_id") % 10 == 1, "DO_NOT_WRITE").otherwise("ANSWER")
    status = F.when(role != "ANSWER", "SKIPPED_BY_ROLE").when(size % 17 == 0, "FAILED_PERMANENT").when(size % 19 == 0, "FAILED_RETRYABLE").otherwise("PROCESSED")
    components = F.expr("int(length(coalesce(text, '')) div 50)")
    content = F.when(components <= 2, "BLANK").when(components <= 40, "SPARSE").otherwise("NORMAL")
    return df.select(
        F.concat(F.lit("D"), F.expr("doc_id div 10").cast("string")).alias("script_id"), F.lit("EXAM").alias("exam_id"), (F.col("doc_id") % 10 + 1).cast("int").alias("page_index"),
        role.alias("page_role"), status.alias("processing_status"), components.alias("components"), F.when(status == "PROCESSED", content).alias("content_class"),
    )


SHEETS = """
sheets AS (
  SELECT *, CASE WHEN processing_status = 'PROCESSED' THEN CASE WHEN components <= 2 THEN 'BLANK' WHEN components <= 40 THEN 'SPARSE' ELSE 'NORMAL' END END AS content_class
  FROM (
    SELECT *, CASE WHEN page_role <> 'ANSWER' THEN 'SKIPPED_BY_ROLE' WHEN size % 17 = 0 THEN 'FAILED_PERMANENT' WHEN size % 19 = 0 THEN 'FAILED_RETRYABLE' ELSE 'PROCESSED' END AS processing_status
    FROM (
      SELECT 'D' || (doc_id // 10) AS script_id, 'EXAM' AS exam_id, (doc_id % 10 + 1)::INT AS page_index, length(coalesce(text, '')) AS size, (length(coalesce(text, '')) // 50)::INT AS components,
        CASE WHEN doc_id % 10 = 0 THEN 'COVER' WHEN doc_id % 10 = 1 THEN 'DO_NOT_WRITE' ELSE 'ANSWER' END AS page_role
      FROM documents)))"""
