"""Parsing of recognised text into prefix, segments, trailing text and the readings that may be meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.config import Grammar
from quillstream.functions import geometry, text

VARIANT = "struct<segments:array<string>,noise_stripped:int,trimmed:int>"


def edge_limit(dpi: Column | float) -> Column:
    return F.greatest(F.lit(2), geometry.mm_to_px(0.5, dpi))


def at_edge(x: Column, dpi: Column | float) -> Column:
    """Whether a box begins so near the page edge that its first digit may be the rest of a cut-off prefix."""
    return x <= edge_limit(dpi)


def prefixes(settings: Grammar) -> list[str]:
    """Longest first, so that QNO wins over Q."""
    return sorted(dict.fromkeys(p.replace(".", "").replace(" ", "").upper() for p in settings.prefixes), key=len, reverse=True)


def match_prefix(letters: Column, settings: Grammar) -> Column:
    """struct<prefix,residue>: an exact prefix, else the longest that the letters end with after few others."""
    known = prefixes(settings)
    found = lambda p, rest: F.struct(F.lit(p).alias("prefix"), rest.alias("residue"))
    out = F.when(letters == "", F.struct(F.lit(None).cast("string").alias("prefix"), F.lit("").alias("residue")))
    for p in known:
        out = out.when(letters == p, found(p, F.lit("")))
    for p in known:
        few = F.length(letters) - len(p) <= settings.max_prefix_residue
        out = out.when(letters.endswith(p) & few, found(p, F.substring(letters, F.lit(1), F.length(letters) - len(p))))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("prefix"), F.lit("").alias("residue")))


def scan(tokens: Column, settings: Grammar) -> Column:
    """struct<segments,stopped,trailing> from the tokens after the first number.

    Separators are skipped; short numbers, single letters and Roman numerals are segments; the rest is trailing text.
    """
    start = F.struct(F.array().cast("array<string>").alias("segments"), F.lit(False).alias("stopped"), F.lit("").alias("trailing"))

    def step(acc: Column, token: Column) -> Column:
        separator = F.instr(F.lit(text.SEPARATORS), token) > 0
        number = text.is_digits(token) & (F.length(token) <= settings.max_sub_digits)
        letter = text.is_letters(token) & ((F.length(token) == 1) | text.is_roman(token))
        taken = number | letter
        stops = acc["stopped"] | ~(separator | taken)
        return F.struct(
            F.when(~stops & taken, F.concat(acc["segments"], F.array(F.lower(token)))).otherwise(acc["segments"]).alias("segments"),
            stops.alias("stopped"),
            F.when(stops, F.concat(acc["trailing"], token)).otherwise(acc["trailing"]).alias("trailing"),
        )

    return F.aggregate(tokens, start, step)


def variants(segments: Column, edge: Column, settings: Grammar) -> Column:
    """array<VARIANT>: leading digits stripped (only at the page edge) times trailing segments trimmed."""
    first, rest = F.element_at(segments, 1), F.size(segments) - 1
    strip = F.when(edge, F.least(F.lit(settings.max_noise_digits), F.length(first) - 1)).otherwise(0)

    def one(s: Column, t: Column) -> Column:
        head = F.substring(first, s + 1, F.length(first))
        return F.struct(
            F.concat(F.array(head), F.slice(segments, 2, rest - t)).alias("segments"), s.cast("int").alias("noise_stripped"), t.cast("int").alias("trimmed")
        )

    trims = F.sequence(F.lit(0), rest)
    return F.flatten(F.transform(F.sequence(F.lit(0), strip), lambda s: F.transform(trims, lambda t: one(s, t))))


def parse(observations: DataFrame, settings: Grammar, edge: Column, text_col: str = "text") -> DataFrame:
    """Adds kind, prefix, residue, segments, trailing, parse_flags, variants and parsed_text.

    text_col holds normalised text (see text.normalised). Each step is a column of its own, so that nothing is computed
    twice; all of it stays in the JVM.
    """
    df = observations.withColumn("_tokens", text.tokens(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_edge", edge)
    df = df.withColumn("_first", F.array_position(F.transform("_tokens", lambda t: text.is_digits(t)), True).cast("int"))
    head = F.when(F.col("_first") > 0, F.slice("_tokens", 1, F.greatest(F.col("_first") - 1, F.lit(0)))).otherwise(F.col("_tokens"))
    df = df.withColumn("_letters", F.upper(F.array_join(F.filter(head, lambda t: text.is_letters(t)), "")))
    df = df.withColumn("_match", match_prefix(F.col("_letters"), settings))
    unknown = (F.col("_letters") != "") & F.col("_match.prefix").isNull()
    after = F.slice("_tokens", F.col("_first") + 1, F.size("_tokens"))
    df = df.withColumn("_number", F.when(F.col("_first") > 0, F.element_at("_tokens", F.greatest(F.col("_first"), F.lit(1)))))
    df = df.withColumn("_scan", F.when(F.col("_first") > 0, scan(after, settings)))
    df = df.withColumn("_segments", F.concat(F.array("_number"), F.col("_scan.segments")))
    df = df.withColumn("_variants", F.when(F.col("_first") > 0, variants(F.col("_segments"), F.col("_edge"), settings)))
    length = F.length("_number")
    too_long = (length > settings.max_first_digits + settings.max_noise_digits) | (
        (length > settings.max_first_digits) & ~F.exists("_variants", lambda v: v["noise_stripped"] > 0)
    )
    kind = (
        F.when(F.col("_first") == 0, F.when(F.col("_match.prefix").isNotNull(), "PREFIX_ONLY").otherwise("NOT_A_MARKER"))
        .when(unknown & (F.length("_letters") > settings.max_prefix_residue), "NOT_A_MARKER")
        .when(too_long, "NOT_A_MARKER")
        .otherwise("MARKER")
    )
    df = df.withColumn("kind", kind)
    marker = F.col("kind") == "MARKER"
    residue = F.when(unknown, F.col("_letters")).otherwise(F.col("_match.residue"))
    flags = text.present((residue != "", "PREFIX_RESIDUE"), (text.has_alnum(F.col("_scan.trailing")), "LINE_TRIMMED"))
    none = F.array().cast("array<string>")
    result = F.struct(
        "kind",
        F.when(F.col("kind") != "NOT_A_MARKER", F.col("_match.prefix")).alias("prefix"),
        F.when(marker, residue).otherwise("").alias("residue"),
        F.when(marker, F.col("_segments")).otherwise(none).alias("segments"),
        F.when(marker, F.col("_scan.trailing")).otherwise("").alias("trailing"),
        F.when(marker, flags).otherwise(none).alias("parse_flags"),
        F.when(marker, F.col("_variants")).otherwise(F.array().cast(f"array<{VARIANT}>")).alias("variants"),
        F.when(marker, text.display(F.col("_segments"))).alias("parsed_text"),
    )
    # a generator keeps later filters from being moved below it, where they would repeat all of the above
    return df.select(*observations.columns, F.inline(F.array(result)))
