"""Quality rules: fixed base limits and a learned decision list, with DataFrame functions only.

``measure`` counts what the rules look at. ``learn`` grows and prunes conjunctions of thresholds over labelled
statistics by sequential covering; ``verdict`` turns the list into one ordered Spark conditional.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import BLANK_CLASS, BLANKS, WORD, digest_sample, held_out, let, release, split_words

WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that conditions may test: parts in a thousand, or tenths of characters for each word.
STATS = ("symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "word_length")
#: Labelled rows that a fit takes at most: those with the smallest digests of their id.
FIT_ROWS = 20_000


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that the text has twice or more, the first included."""

    def digests_of(words: Column) -> Column:
        of_words = F.transform(words, lambda w: F.xxhash64(w))
        window = lambda h, i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
        return let(of_words, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: window(h, i)))

    def covered(digests: Column) -> Column:
        # sorted by digest, a repeated window stands beside its like; their places, sorted, cover WINDOW words each
        def places(pairs: Column) -> Column:
            like = lambda x, i: F.coalesce(F.get(pairs, i)["digest"] == x["digest"], F.lit(False))
            return F.sort_array(
                F.transform(
                    F.filter(pairs, lambda x, i: like(x, i - 1) | like(x, i + 1)),
                    lambda x: x["place"],
                )
            )

        pairs = F.sort_array(F.transform(digests, lambda h, i: F.struct(h.alias("digest"), i.alias("place"))))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        step = lambda acc, p: F.struct(
            (p + WINDOW).alias("end"), (acc["total"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("total")
        )
        return let(pairs, lambda x: F.aggregate(places(x), start, step)["total"])

    some = lambda digests: F.when(F.size(F.array_distinct(digests)) < F.size(digests), covered(digests)).otherwise(0)
    # words is bound once: a filter that the optimizer moves would otherwise put its whole expression in the lambda
    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(digests_of(w), some)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep, BASE and STATS for each row. Null text counts as empty; without words every statistic is 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the few characters that are counted are set apart in one pass over the text
    few = F.regexp_replace("_text", r"[^\p{Lu}0-9!?#*$%&|<>]+", "")
    rows = docs.select(F.col(id_col), *keep, text.alias("_text")).select(
        id_col, *keep, "_text", split_words(F.col("_text"), BLANK_CLASS, BLANKS).alias("_words"), few.alias("_few")
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    count = lambda others: F.length(F.regexp_replace("_few", others, "")).cast("long")
    rows = rows.select(
        id_col,
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        count(r"[^\p{Lu}]+").alias("_capitals"),
        count(r"[^0-9]+").alias("_digits"),
        count(r"[^!?]+").alias("_marks"),
    )
    per = lambda part, of: F.when(F.col(of) > 0, F.floor(F.lit(1000) * F.col(part) / F.col(of))).otherwise(0).cast("long")
    rows = rows.withColumn("n_dup_lines", F.col("_lines.dup").cast("long")).withColumn("_n_lines", F.col("_lines.n"))
    words = F.when(F.col("n_words") > 0, F.floor(10 * F.col("word_chars") / F.col("n_words"))).otherwise(0)
    values = F.struct(
        *BASE,
        per("n_symbols", "word_chars").alias("symbols"),
        per("n_dup_lines", "_n_lines").alias("dup_lines"),
        per("n_repeat_words", "n_words").alias("repeats"),
        per("_capitals", "word_chars").alias("capitals"),
        per("_digits", "word_chars").alias("digits"),
        per("_marks", "n_words").alias("marks"),
        words.cast("long").alias("word_length"),
    )
    # a generator keeps later filters from being moved below it, where they would measure everything again
    return rows.select(id_col, *keep, F.inline(F.array(values)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject where every condition holds; a condition is (statistic, '>=' or '<=', threshold)."""

    conditions: tuple[tuple[str, str, int], ...]

    def holds(self, row: dict) -> bool:
        return all(row[s] >= t if op == ">=" else row[s] <= t for s, op, t in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for s, op, t in self.conditions:
            out = out & (F.col(s) >= t if op == ">=" else F.col(s) <= t)
        return out


def _grow(rows: list[dict], cuts: dict[str, list[int]], most: int) -> Rule:
    """Adds the condition with the best gain (as in FOIL) until no good row is covered or none helps."""
    import math

    conditions: tuple = ()
    while len(conditions) < most:
        bad = sum(r["bad"] for r in rows)
        good = len(rows) - bad
        if not good or not bad:
            break
        now, best, pick = math.log2(bad / (bad + good)), 1e-9, None
        for s, thresholds in cuts.items():
            values = sorted((r[s], r["bad"]) for r in rows)
            for op, ordered in ((">=", values[::-1]), ("<=", values)):
                b = g = at = 0
                for t in thresholds[::-1] if op == ">=" else thresholds:
                    while at < len(ordered) and (ordered[at][0] >= t if op == ">=" else ordered[at][0] <= t):
                        b, g, at = b + ordered[at][1], g + 1 - ordered[at][1], at + 1
                    gain = b * (math.log2(b / (b + g)) - now) if b else 0
                    if gain > best:
                        best, pick = gain, (s, op, t)
        if not pick:
            break
        conditions = (*conditions, pick)
        rows = [r for r in rows if Rule((pick,)).holds(r)]
    return Rule(conditions)


def _prune(rule: Rule, rows: list[dict]) -> tuple[Rule, float]:
    """Drops last conditions while that raises (bad - good) / covered on rows kept from growing."""

    def worth(x: Rule) -> float:
        covered = [r["bad"] for r in rows if x.holds(r)]
        return (2 * sum(covered) - len(covered)) / len(covered) if covered else -1.0

    best, value = rule, worth(rule)
    for n in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:n])
        if (w := worth(shorter)) >= value:
            best, value = shorter, w
    return best, value


def cover(rows: list[dict], most_rules: int = 8, most_conditions: int = 3, least_worth: float = 0.9, least_share: float = 0.005) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on the rest, drop what the rule covers, again.

    rows have STATS, 'bad' (0 or 1) and are in a fixed order. It stops when a rule is right too seldom on the rows kept
    for pruning, or covers too few bad rows.
    """
    out: list[Rule] = []
    total = sum(r["bad"] for r in rows)
    while len(out) < most_rules and any(r["bad"] for r in rows):
        grown = [r for i, r in enumerate(rows) if i % 3 != 2]
        kept = [r for i, r in enumerate(rows) if i % 3 == 2]
        cuts = {}
        for s in STATS:
            values = sorted({r[s] for r in grown})
            cuts[s] = values if len(values) <= 64 else [values[i * (len(values) - 1) // 63] for i in range(64)]
        rule, worth = _prune(_grow(grown, cuts, most_conditions), kept)
        caught = [r for r in rows if rule.holds(r)]
        if not rule.conditions or worth < least_worth or sum(r["bad"] for r in caught) < max(2, least_share * total):
            break
        out.append(rule)
        rows = [r for r in rows if not rule.holds(r)]
    return out


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """A decision list from labelled rows that are not held out and pass the base limits.

    The fit takes fit_rows rows at most, those with the smallest digests of their id. Null labels, unmatched ids and ids
    labelled in two ways are left out; with none left the list is empty and rejects nothing.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_low"), F.max(label_col).alias("_high"))
    marked = digest_sample(marked.where("_low = _high"), "_id", fit_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")).join(F.broadcast(marked) if fit_rows <= FIT_ROWS else marked, "_id")
    rows = measure(rows, "_id", "_body", ("_low",)).where(~base_failed()).orderBy(F.md5(F.col("_id").cast("string")), "_id")
    rules = cover([{"bad": int(r["_low"] == 0), **{s: r[s] for s in STATS}} for r in rows.select("_low", *STATS).limit(fit_rows).collect()])
    release()
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, rule): the ordered conditional and the number of the rule that decided, null for none."""
    kept = F.when(base_failed(), F.lit(False))
    number = F.when(base_failed(), F.lit(0))
    for i, rule in enumerate(rules, 1):
        kept, number = kept.when(rule.column(), F.lit(False)), number.when(rule.column(), F.lit(i))
    return kept.otherwise(F.lit(True)), number


def quality_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep, BASE, base_failed, rule and kept for each row of docs.

    Null, empty and blank texts have no words and fail the base limits. Ids may be null or repeated: a row's result
    depends on its text alone. An empty table gives an empty result.
    """
    kept, number = verdict(rules)
    return measure(docs, id_col, text_col, keep).select(
        id_col, *keep, *BASE, base_failed().alias("base_failed"), number.cast("int").alias("rule"), kept.alias("kept")
    )
