"""Proportional stratified interleaving: shards of equal counts whose mixture of sources follows the whole.

Rows of a source are shuffled by a seeded digest and ranked. Row r (from 1) of a source with n rows has the fractional
rank (2r - 1) / 2n. All rows sorted by it interleave the sources in proportion, and equal cuts of that order hold every
source in proportion, give or take one row for each source.

No source or range is gathered in one task. Both rankings have three levels: rows are counted by small buckets of the
sort key, and only rows of one bucket are sorted together; the counts of buckets are summed up within groups of buckets,
and the counts of groups within a source. With N rows there are about N / BUCKET_ROWS buckets, and no group or list of
groups has more than about the square root of that. Only rows equal in id, text and source always share a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket should hold; the number of buckets follows the number of rows.
BUCKET_ROWS = 4096


def _before(counts: DataFrame, group: list[str], by: str, out: str) -> DataFrame:
    """counts without _n, and with the sum of _n over what comes before in its group."""
    earlier = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[str], out: str, bits: int) -> DataFrame:
    """Adds out: the position from 0 among the rows of a group by (bucket, order). Buckets have about ``bits`` bits."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n")).withColumn("_wide", F.shiftright(bucket, bits // 2))
    wide = counts.groupBy(*group, "_wide").agg(F.sum("_n").alias("_n"))
    starts = _before(wide, group, "_wide", "_far").join(_before(counts, [*group, "_wide"], bucket, "_near"), [*group, "_wide"])
    starts = starts.select(*group, bucket, (F.col("_far") + F.col("_near")).alias("_start"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    placed = rows.withColumn("_row", F.row_number().over(inside) - 1)
    return placed.join(starts, [*group, bucket]).withColumn(out, F.col("_start") + F.col("_row")).drop("_start", "_row")


def shard(
    docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, text_crc32, source, law, shard, slot, grown_shard) for every row of docs.

    size is the text's UTF-8 bytes plus 16. shard i takes positions ceil(i*N/shards) onwards, so counts differ by one at
    most; slot counts from 0 inside a shard. law is 'rows' and grown_shard null: another shard count is another cut.
    Null text: no bytes, crc32 of nothing (0). Null source: a stratum of its own. Null ids and repeated rows are rows
    like others, each with its own slot. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
        F.col(source_col).isNull().alias("_sourceless"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        # the text as well, so that rows without an id are dealt over all buckets
        F.md5(F.concat_ws("|", F.lit(str(seed)), ident, F.crc32(text).cast("string"), (F.octet_length(text) + 16).cast("string"))).alias("_key"),
    )
    total = rows.count()
    bits = max(8, (max(1, total // BUCKET_ROWS) - 1).bit_length())
    source = ["_source", "_sourceless"]
    # the digest's first bits, so that buckets follow the order of digests and their number changes no rank
    rows = rows.withColumn("_bucket", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), 32 - min(bits, 32)))
    ranked = _ranked(rows, source, "_bucket", ["_key", "doc_id", "size", "text_crc32"], "_rank", bits)
    sizes = rows.groupBy(*source).agg(F.count(F.lit(1)).alias("_of"))
    ranked = ranked.join(sizes, source).withColumn("_fraction", (2 * F.col("_rank") + 1) / (2.0 * F.col("_of")))
    ranked = ranked.withColumn("_slice", F.floor(F.col("_fraction") * (1 << bits)).cast("long")).withColumn("_all", F.lit(0))
    order = ["_fraction", *source, "_rank"]
    placed = _ranked(ranked, ["_all"], "_slice", order, "_pos", bits)
    # whole-number quotients, exact for any size
    at = F.expr(f"(_pos * {shards}) div {total}") if total else F.lit(0).cast("long")
    first = F.expr(f"(_shard * {total} + {shards} - 1) div {shards}")
    return (
        placed.withColumn("_shard", at)
        .withColumn("_first", first)
        .select(
            "doc_id", "size", "text_crc32", F.when(~F.col("_sourceless"), F.col("_source")).alias("source"),
            F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
            (F.col("_pos") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
