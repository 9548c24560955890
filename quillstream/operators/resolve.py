"""Resolution of readings against the vocabulary by confusion-weighted similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.config import Resolution
from quillstream.functions import distance, text

#: Identifiers of all exams that are broadcast at most, of some hundred bytes each.
BROADCAST_TARGETS = 200_000
COLUMNS = ("outcome", "method", "question", "resolution_confidence", "resolution_margin", "candidates", "resolution_flags", "matched_key")


def _small(df: DataFrame, most: int = BROADCAST_TARGETS) -> DataFrame:
    """df, broadcast if it is no longer than ``most`` rows; otherwise the join may shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scores(readings: DataFrame, vocabulary: DataFrame, settings: Resolution) -> DataFrame:
    """(reading, exam_id, question, ord, score, exact, variant): each question's best variant of each reading.

    readings has reading (an id), exam_id and variants. Every reading meets the targets of its own exam, a join on the
    exam, so the work is readings times the length of one list. On equal scores an exact variant wins, then the earlier.
    """
    targets = vocabulary.where("is_target").select("exam_id", F.col("canonical").alias("question"), F.col("key").alias("_key"), F.col("flat").alias("_flat"), "ord")
    tried = readings.select("reading", "exam_id", F.posexplode("variants").alias("pos", "variant"))
    tried = tried.withColumn("_seen", text.flat(F.col("variant.segments"))).withColumn("_seen_key", text.key(F.col("variant.segments")))
    pairs = tried.join(_small(targets), "exam_id")
    exact = F.col("_seen_key") == F.col("_key")
    penalty = F.col("variant.noise_stripped") * settings.noise_penalty + F.col("variant.trimmed") * settings.trim_penalty
    alike = F.when(exact, F.lit(1.0)).otherwise(distance.similarity(F.col("_seen"), F.col("_flat"), settings))
    pairs = pairs.withColumn("exact", exact).withColumn("score", alike - penalty)
    best = F.max(F.struct("score", "exact", (-F.col("pos")).alias("early"), "variant"))
    out = pairs.groupBy("reading", "exam_id", "question", "ord").agg(best.alias("_best"))
    return out.select("reading", "exam_id", "question", "ord", F.col("_best.score").alias("score"), F.col("_best.exact").alias("exact"), F.col("_best.variant").alias("variant"))


def decide(scored: DataFrame, settings: Resolution) -> DataFrame:
    """One row for each reading: reading and COLUMNS.

    Questions rank by score, exactness and their order in the list. A unique exact match is taken whatever its score; a
    match by similarity needs the threshold and a margin to the second.
    """
    ranked = F.sort_array(F.collect_list(F.struct("score", "exact", (-F.col("ord")).alias("early"), "question", "variant")), asc=False)
    df = scored.groupBy("reading").agg(ranked.alias("_ranked")).withColumn("_best", F.col("_ranked")[0]).withColumn("_second", F.get("_ranked", F.lit(1)))
    score = F.col("_best.score")
    margin = F.greatest(F.lit(0.0), score - F.coalesce("_second.score", F.lit(0.0)))
    tie = F.coalesce(F.col("_second.exact") & (F.col("_second.score") == score), F.lit(False))
    sure = F.col("_best.exact") & ~tie
    enough = score >= settings.match_threshold
    outcome = F.when(sure, "RESOLVED").when(enough & (margin >= settings.margin_threshold), "RESOLVED").when(enough, "AMBIGUOUS").otherwise("NO_MATCH")
    method = F.when(sure, "EXACT_UNIQUE").when(enough & (margin >= settings.margin_threshold), "CONSTRAINED_UNIQUE").otherwise("NONE")
    top = F.transform(
        F.slice("_ranked", 1, 5),
        lambda x: F.struct(x["question"].alias("question_id"), F.bround(F.greatest(x["score"], F.lit(0.0)), 4).alias("score")),
    )
    variant = F.col("_best.variant")
    return df.select(
        "reading",
        outcome.alias("outcome"),
        method.alias("method"),
        F.when(outcome == "RESOLVED", F.col("_best.question")).alias("question"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("resolution_confidence"),
        margin.alias("resolution_margin"),
        top.alias("candidates"),
        text.present((variant["noise_stripped"] > 0, "NOISE_STRIPPED"), (variant["trimmed"] > 0, "LINE_TRIMMED")).alias("resolution_flags"),
        text.key(variant["segments"]).alias("matched_key"),
    )


def resolve(parsed: DataFrame, vocabulary: DataFrame, settings: Resolution) -> DataFrame:
    """parsed (exam_id, kind, variants, ...) with COLUMNS and is_confusable; null where there is nothing to resolve.

    Texts repeat far more often than they differ: distinct variant lists are scored once, then joined back. Rows without
    a reading join on a key of their own, so that they do not meet in one task.
    """
    name = F.xxhash64("exam_id", F.transform("variants", lambda v: F.concat(text.key(v["segments"]), F.lit("/"), v["noise_stripped"], F.lit("/"), v["trimmed"])))
    simple = [c for c, kind in parsed.dtypes if kind in ("string", "int", "bigint", "boolean")]
    marked = parsed.withColumn("_is", F.col("kind") == "MARKER").withColumn("reading", F.when(F.col("_is"), name).otherwise(F.xxhash64(*simple)))
    readings = marked.where("_is").select("reading", "exam_id", "variants").dropDuplicates(["reading"])
    found = decide(scores(readings, vocabulary, settings), settings).withColumn("_is", F.lit(True))
    unsure = vocabulary.where(F.size("confusable_with") > 0).select("exam_id", F.col("canonical").alias("question"), F.lit(True).alias("is_confusable"))
    out = marked.join(found, ["reading", "_is"], "left").join(_small(unsure), ["exam_id", "question"], "left")
    some = (F.col("kind") == "MARKER") & F.col("outcome").isNull()  # a list without targets
    return (
        out.withColumn("is_confusable", F.coalesce("is_confusable", F.lit(False)))
        .withColumn("outcome", F.when(some, "NO_MATCH").otherwise(F.col("outcome")))
        .withColumn("method", F.coalesce("method", F.lit("NONE")))
        .drop("reading", "_is")
    )
