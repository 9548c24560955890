"""The corpus pipeline: rules, language, near-duplicates, benchmark passages, then ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What a
stage decides takes effect on the next one's rows. A decision holds for rows equal in id and text: an id may be null, or
stand for several texts. A stage's result is written as Parquet and read again. A stage lets the executors give back what
those before it left in their heaps, so that its Python workers find memory beside them.

* quality rules: rows that the base limits or the learned list reject go;
* language ID: texts without letters, and texts of no clear language, go; where no row says its language, none is unclear;
* near-duplicates: the row with the smallest id of each group stays, and one of rows that are equal in id and text; rows
  without an id come last in their group;
* decontamination: rows with a window of a benchmark item go;
* SentencePiece: the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontaminate, language_crf, near_dedup, quality_rules, sentencepiece_fst
from quillstream.llm.common import Workspace, release_executors, row_key, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose likeliest language has a smaller mean probability over its words is of no clear language.
LEAST_LANGUAGE = 0.4
#: Keys of rows that go, broadcast at most (64 MB).
BROADCAST_IDS = 8_000_000
#: No SQL expresses a learned list, the random field or the encoding.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def _row() -> Column:
    return row_key(F.col("doc_id"), F.col("text")).alias("_row")


def _chosen(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs with _row, joined on it (left_anti or left_semi). Up to BROADCAST_IDS keys are broadcast, so that no text is moved."""
    rows = rows.distinct()
    small = rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.select(*_columns(docs), _row()).join(F.broadcast(rows) if small else rows, "_row", how)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of docs whose key is not among rows (_row)."""
    return _chosen(docs, rows, "left_anti").select(*_columns(docs))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base limits and the list learned from the labels accept.

    Null and empty texts have no words and go; so does every row equal to one that goes. Without labels only the base
    limits decide. An empty table stays empty. Columns other than COLUMNS are dropped.
    """
    release_executors(spark)
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    keep = tuple(c for c in _columns(docs) if c != "doc_id")
    return quality_rules.quality_rules(docs, rules, keep=keep).where("kept").select(*_columns(docs))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of a clear language, LEAST_LANGUAGE or more.

    Null and letterless texts go. A model that knows no language (no row says its own, or there is no such column) tells
    nothing: all texts with letters stay then. Ties of languages change no score. An empty table stays empty.
    """
    keep = tuple(c for c in _columns(docs) if c != "doc_id")
    labelled = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    model = language_crf.fit(labelled)
    release_executors(spark)
    found = language_crf.identify(docs, model, keep=keep, least=LEAST_LANGUAGE if model.labels else None)
    return (found if model.labels else found.where("n_words > 0")).select(*_columns(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of near-duplicates; of rows equal in id and text, one.

    First is the smallest id, null last, and then the smaller row key; of equal rows the one whose other columns come
    first. Texts without words are like no other and stay. An empty table stays empty.
    """
    release_executors(spark)
    space = Workspace(spark, "dedup-stage")
    found = near_dedup.groups(docs).select(F.col("row").alias("_row"), (F.col("row") == F.col("first_row")).alias("_first"))  # a written table
    gone = found.where("not _first").select("_row")
    repeated = space.hold(found.where("_first").groupBy("_row").count().where("count > 1").select("_row"), "repeated", 1)
    if repeated.isEmpty():
        return _without(docs, gone)
    # rows that are equal in id and text are rare: only these are grouped, by the smallest of their other columns
    columns = _columns(docs)
    several = _chosen(docs, repeated, "left_semi").groupBy("_row").agg(F.min(F.struct(*columns)).alias("_one"))
    return _without(docs, gone.unionAll(repeated)).unionByName(several.select("_one.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows without any window of a benchmark item.

    Null and wordless texts stay, and everything does if no item has a word. Rows equal in id and text share their
    verdict, texts that share an id do not. An empty table stays empty.
    """
    release_executors(spark)
    space = Workspace(spark, "decontamination-stage")
    keyed = docs.select("doc_id", "text", _row())
    found = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), keep=("_row",)).where("contaminated")
    return _without(docs, space.hold(found.select("_row"), "hit", 1))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, a row for each row: null and empty texts have none. See sentencepiece_fst.encode."""
    release_executors(spark)
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each held in the shared folder before the next."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = space.hold(docs, name, None)
            if i:
                space.drop(STAGES[i - 1][0])
    return docs
