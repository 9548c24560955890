"""The list of valid identifiers as a table: hierarchy, types, targets, collisions, and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text


class VocabularyError(ValueError):
    """A list of identifiers, or its answering rules, is not valid."""


def parsed(entries: DataFrame) -> DataFrame:
    """entries (exam_id, version, ord, raw, explicit_target) with segments, key, flat and canonical."""
    raw = text.stripped(F.coalesce("raw", F.lit("")))
    rows = entries.withColumn("raw", raw).withColumn("segments", text.split_segments(F.col("raw")))
    s = F.col("segments")
    return rows.withColumn("key", text.key(s)).withColumn("flat", text.flat(s)).withColumn("canonical", text.display(s))


def parents(rows: DataFrame) -> DataFrame:
    """(exam_id, key): every proper prefix of an identifier's segments."""
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size("segments") - 1, F.lit(0))), lambda i: i > 0),
        lambda i: F.array_join(F.slice(F.col("segments"), 1, i), "|"),
    )
    return rows.select("exam_id", F.explode(prefixes).alias("key")).distinct()


def segment_types(rows: DataFrame) -> DataFrame:
    """(exam_id, ord, segment_types): NUM, ROMAN or ALPHA for each segment, Roman as its siblings agree."""
    each = rows.select("exam_id", "ord", "segments", F.posexplode("segments").alias("depth", "segment"))
    each = each.withColumn("parent", F.array_join(F.slice("segments", 1, F.col("depth")), "|"))
    group = Window.partitionBy("exam_id", "parent", "depth")
    letters = text.is_letters(F.col("segment"))
    roman = F.min(F.when(letters, text.is_roman(F.col("segment")))).over(group) & F.max(F.length("segment") > 1).over(group)
    # an identifier's first segment has no siblings
    roman = F.when(F.col("depth") == 0, F.lit(False)).otherwise(F.coalesce(roman, F.lit(False)))
    kind = F.when(text.is_digits(F.col("segment")), "NUM").when(roman | (F.length("segment") > 1), "ROMAN").otherwise("ALPHA")
    typed = each.withColumn("kind", kind).groupBy("exam_id", "ord")
    return typed.agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "kind"))), lambda x: x["kind"]).alias("segment_types"))


def confusable(rows: DataFrame) -> DataFrame:
    """rows with confusable_with: other identifiers of the same characters, sorted."""
    same = Window.partitionBy("exam_id", "flat")
    others = F.array_except(F.sort_array(F.collect_set("canonical").over(same)), F.array("canonical"))
    return rows.withColumn("confusable_with", others)


def build(entries: DataFrame) -> DataFrame:
    """The vocabulary: exam_id, version, ord, raw, segments, segment_types, key, flat, canonical, is_target,
    confusable_with. A list is not checked here: see errors and validated."""
    rows = parsed(entries)
    above = parents(rows).withColumn("_parent", F.lit(True))
    rows = rows.join(segment_types(rows), ["exam_id", "ord"], "left").join(above, ["exam_id", "key"], "left")
    rows = rows.withColumn("is_target", F.coalesce("explicit_target", F.col("_parent").isNull())).drop("_parent")
    return confusable(rows)


def errors(entries: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(exam_id, ord, raw, error): everything wrong with each list; ord is null for errors of a list as a whole."""
    rows = parsed(entries)
    start = (F.size("segments") == 0) | ~text.is_digits(F.coalesce(F.get("segments", F.lit(0)), F.lit("")))
    bad = F.exists("segments", lambda s: text.is_letters(s) & (F.length(s) > 1) & ~text.is_roman(s))
    repeat = F.row_number().over(Window.partitionBy("exam_id", "key").orderBy("ord")) > 1
    # what stops earlier phases hides later ones for the same entry
    kind = (
        F.when(start, "INVALID_START").when(~text.allowed_id(F.col("raw")), "INVALID_CHARACTERS").when(F.col("_repeat"), "DUPLICATE").when(bad, "INVALID_SEGMENT")
    )
    found = rows.withColumn("_repeat", repeat).withColumn("error", kind).where("error is not null").select("exam_id", "ord", "raw", "error")
    none = F.lit(None)
    targets = build(entries).groupBy("exam_id").agg(F.max("is_target").alias("_some")).where("not _some")
    found = found.unionByName(targets.select("exam_id", none.cast("int").alias("ord"), none.cast("string").alias("raw"), F.lit("NO_TARGETS").alias("error")))
    if rules is not None:
        wrong = rules.where("min_answers > max_answers").select("exam_id", none.cast("int").alias("ord"), none.cast("string").alias("raw"), F.lit("MIN_ABOVE_MAX").alias("error"))
        found = found.unionByName(wrong)
    return found


def validated(entries: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The vocabulary, or VocabularyError with the first error of the first phase that fails."""
    if entries.isEmpty():
        raise VocabularyError("the list is empty")
    phase = F.when(F.col("error").isin("INVALID_START", "INVALID_CHARACTERS"), 0).when(F.col("error") == "DUPLICATE", 1).otherwise(2)
    first = errors(entries, rules).orderBy(phase, F.asc_nulls_last("ord")).first()
    if first:
        raise VocabularyError(f"{first['error']}: {first['raw']!r}" if first["raw"] is not None else first["error"])
    return build(entries)
