"""Reading of texts: normal form, parsing and resolution of each distinct text, once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.config import Settings
from quillstream.functions import text
from quillstream.operators import grammar, resolve

#: Distinct texts whose readings are broadcast at most, of up to about a thousand bytes each.
BROADCAST_TEXTS = 100_000


def read(observations: DataFrame, vocabulary: DataFrame, settings: Settings, edge: Column, text_col: str = "raw") -> DataFrame:
    """observations (exam_id, text_col, ...) with text and all columns of grammar.parse and resolve.resolve.

    What a text means depends on its exam, itself and whether it stands at the page's edge. Margins hold the same few
    texts over and over, so these three are made distinct, read, and joined back: by broadcast where they are few, else
    by a shuffle whose hot texts adaptive execution splits. A null text is an empty one, a null edge is no edge.
    """
    rows = observations.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_edge", F.coalesce(edge, F.lit(False)))
    keys = rows.select(F.col("exam_id"), "_text", "_edge").distinct()
    few = keys.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    found = resolve.resolve(grammar.parse(text.normalised(keys, "_text"), settings.grammar, F.col("_edge")), vocabulary, settings.resolution)
    found = found.select(*(F.col(c).alias(f"{c}_") if c in ("exam_id", "_text", "_edge") else F.col(c) for c in found.columns))
    same = rows["exam_id"].eqNullSafe(found["exam_id_"]) & (rows["_text"] == found["_text_"]) & (rows["_edge"] == found["_edge_"])
    return rows.join(F.broadcast(found) if few else found, same, "left").drop("exam_id_", "_text_", "_edge_", "_text", "_edge")
