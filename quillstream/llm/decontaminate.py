"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of ``window`` words; a shorter item is one window. A window is the set of its shingles of
SHINGLE words (fewer for shorter windows). Containment needs all of them, so the necessary prefix in an order by rarity
is one shingle: the window's rarest over all documents. Documents are joined on that shingle alone; its position fixes
where the window would have to start and end (positional and length bounds), and the words there are compared.

The items' shingles are broadcast only if there are at most ``broadcast_rows`` of them. Beyond that, positions are
joined by a shuffle on the shingle, which adaptive execution splits where a shingle is hot, and candidates are joined to
their documents again to be verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import lower_ascii

SHINGLE = 3
#: Of up to about 300 bytes each: 60 MB at most.
BROADCAST_ROWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_text(text: Column) -> Column:
    """Words, with an empty string before a separator that begins the text and after one that ends it.

    No window has an empty word, so these ends never match; trimming them would read every text again.
    """
    return F.split(lower_ascii(text), SEPARATORS)


def item_words(text: Column) -> Column:
    return F.filter(split_text(text), lambda w: w != "")


def n_words(parts: Column) -> Column:
    """How many words split_text has found."""
    ends = (F.get(parts, 0) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - ends).cast("long")


def _shingle(words: Column, pos: Column, k: int) -> Column:
    """Digest of k words from pos (from 0); null if they don't all exist."""
    parts = [F.try_element_at(words, (pos + F.lit(i + 1)).cast("int")) for i in range(k)]
    return F.when(pos + F.lit(k) <= F.size(words), F.xxhash64(*parts))


def item_windows(items: DataFrame, window: int, item_id: str, item_text: str) -> DataFrame:
    """(item_id, first, n, words): each window of each item with words, once."""
    words = items.select(F.col(item_id).alias("item_id"), item_words(F.coalesce(F.col(item_text), F.lit(""))).alias("_all"))
    words = words.where(F.size("_all") > 0).withColumn("n", F.least(F.lit(window), F.size("_all")))
    starts = words.withColumn("first", F.explode(F.expr("sequence(0, size(_all) - n)")))
    return starts.select("item_id", "n", F.slice("_all", F.col("first") + 1, F.col("n")).alias("words")).distinct()


def _positions(docs: DataFrame, ks: list[int]) -> DataFrame:
    """(_key, _words, pos, k, shingle) for all positions and lengths; _words is not copied before a join in the same stage.

    An outer generator, as for an inner one the optimizer adds a filter that splits every text once more.
    """
    rows = docs.select("_key", "_words", F.posexplode_outer("_words").alias("pos", "_w"))
    if len(ks) == 1:
        one = _shingle(F.col("_words"), F.col("pos"), ks[0]).alias("shingle")
        return rows.select("_key", "_words", "pos", F.lit(ks[0]).alias("k"), one).where("shingle is not null")
    each = F.array(*(F.struct(F.lit(k).alias("k"), _shingle(F.col("_words"), F.col("pos"), k).alias("shingle")) for k in ks))
    return rows.select("_key", "_words", "pos", F.inline(each)).where("shingle is not null")


def matches(docs: DataFrame, windows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """(_key, item_id, first, n): where the words of docs (_key, _words) have a window of windows; None without windows."""
    windows = windows.withColumn("k", F.least(F.lit(SHINGLE), "n")).withColumn("_id", F.xxhash64("n", "words"))
    # k is 1 to SHINGLE
    sizes = {r.k: r.n for r in windows.groupBy("k").agg(F.sum(F.col("n") - F.col("k") + 1).alias("n")).collect()}
    if not sizes:
        return None
    small = sum(sizes.values()) <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)
    own = windows.select("_id", "k", "words", F.explode(F.expr("sequence(0, n - k)")).alias("at"))
    shingle = F.coalesce(*(F.when(F.col("k") == k, _shingle(F.col("words"), F.col("at"), k)) for k in sorted(sizes)))
    own = own.withColumn("shingle", shingle)
    where = _positions(docs, sorted(sizes))
    seen = where.select("k", "shingle").join(hint(own.select("k", "shingle").distinct()), ["k", "shingle"]).groupBy("k", "shingle").count()
    rarest = Window.partitionBy("_id").orderBy(F.coalesce("count", F.lit(0)), "shingle", "at")
    prefix = (
        own.join(seen, ["k", "shingle"], "left")
        .withColumn("_rank", F.row_number().over(rarest))
        .where("_rank = 1 and count is not null")  # a shingle that no document has: neither does one have the window
        .select("_id", "at", "k", "shingle")
    )
    whole = windows.select("_id", "item_id", "n", F.col("words").alias("_window")).join(prefix, "_id").drop("_id")
    first, fits = F.col("pos") - F.col("at"), "pos >= at and pos - at + n <= size(_words)"
    same = F.slice("_words", F.col("pos") - F.col("at") + 1, F.col("n")) == F.col("_window")
    if small:
        hits = where.join(F.broadcast(whole), ["k", "shingle"]).where(fits).where(same)
    else:
        near = where.select("_key", "pos", "k", "shingle").join(whole, ["k", "shingle"]).where("pos >= at")
        hits = near.join(docs, "_key").where(fits).where(same)
    return hits.select("_key", "item_id", first.cast("int").alias("first"), F.col("n").cast("int").alias("n"))


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "doc_id",
    text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, keep, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    Words are runs of ASCII digits, letters (A-Z lowered) and characters beyond ASCII. n_hit counts a document's words
    inside any occurrence of a window, n_items the items with such windows. Null or wordless texts: zeros, the digest of
    nothing, not contaminated; null or wordless items: no window. An item without an id hits words like others, and
    counts and is named as the item "null"; items that share an id count once. Repeated rows are told apart by id and text, so equal
    rows get equal results, one each; a null id is an id. An empty table of items leaves every document clean. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *keep)
    # the id itself and not only a hash: texts of different ids are never taken for one
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("_text").alias("hash"), F.octet_length("_text").alias("size"))
    keyed = rows.select(key.alias("_key"), split_text(F.col("_text")).alias("_words"))
    base = rows.select(key.alias("_key"), "doc_id", *keep, split_text(F.col("_text")).alias("_parts"))
    base = base.select("_key", "doc_id", *keep, n_words(F.col("_parts")).alias("n_words"))
    hits = matches(keyed, item_windows(items, window, item_id, item_text), broadcast_rows)
    none = F.sha2(F.lit(""), 256)
    if hits is None:
        return base.select("doc_id", *keep, "n_words", *(F.lit(0).cast("long").alias(c) for c in ("n_hit", "n_items")), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    # both from one pass: a text's hits are no more than its words times the items that share a window
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    found = hits.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("first", "n"))).alias("_spans"), F.sort_array(F.collect_set(item)).alias("_items"))
    # words under the union of intervals: each adds what lies beyond the furthest end before it
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, x: Column) -> Column:
        end = x["first"] + x["n"]
        new = F.greatest(F.lit(0), end - F.greatest(x["first"], acc["end"]))
        return F.struct(F.greatest(end, acc["end"]).alias("end"), (acc["total"] + new).alias("total"))

    found = found.select("_key", F.aggregate("_spans", start, step)["total"].alias("n_hit"), "_items")
    return base.join(found, "_key", "left").select(
        "doc_id",
        *keep,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.array_join("_items", ","), 256), none).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
