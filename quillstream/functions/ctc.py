"""Scores of texts under a recogniser's character probabilities, frame by frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_likelihood(frames: np.ndarray, target: list[int], blank: int = 0) -> float:
    """log of the probability that frames (time x symbols, probabilities) spell target: the sum over all alignments.

    An alignment names a symbol in each frame; repeats are joined, then blanks dropped. Minus infinity if none fits.
    """
    wanted = np.full(2 * len(target) + 1, blank)
    wanted[1::2] = target
    # a state is reached from itself, the one before, and past a blank from the one before that unless it is the same symbol
    skips = np.concatenate(([False, False], (wanted[2:] != blank) & (wanted[2:] != wanted[:-2])))
    state, total = np.zeros(len(wanted)), 0.0
    state[0] = 1.0
    before = True
    for row in frames:
        if before:
            moved = np.zeros(len(wanted))
            moved[:2] = 1.0
            before = False
        else:
            moved = state.copy()
            moved[1:] += state[:-1]
            moved[2:] += np.where(skips[2:], state[:-2], 0.0)
        state = moved * row[wanted]
        scale = state.sum()
        if scale <= 0:
            return -np.inf
        state /= scale
        total += np.log(scale)
    if before:
        return 0.0 if not target else -np.inf
    end = state[-2:].sum()
    return float(total + np.log(end)) if end > 0 else -np.inf


def surface_forms(segments: Column) -> Column:
    """The forms in which an identifier may be written: 10b1, 10(b)(1) and 10b1)."""
    rest = F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0)))
    flat, head = F.array_join(segments, ""), F.element_at(segments, 1)
    brackets = F.concat(head, F.array_join(F.transform(rest, lambda s: F.concat(F.lit("("), s, F.lit(")"))), ""))
    return F.array_distinct(F.array(flat, brackets, F.concat(flat, F.lit(")"))))


def scored(readings: DataFrame, targets: DataFrame, alphabet: str) -> DataFrame:
    """(reading, question, log_likelihood): each target of a reading's exam by its likeliest form.

    readings: reading, exam_id, frames (array of arrays of probabilities; symbol 0 is the blank, the others are alphabet).
    targets: exam_id, question, segments. A form with characters beyond the alphabet has no likelihood.
    """
    codes = {c: i + 1 for i, c in enumerate(alphabet)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for r in df.itertuples():
                frames = np.array([list(x) for x in r.frames], float).reshape(len(r.frames), len(alphabet) + 1)
                best = [log_likelihood(frames, [codes[c] for c in form]) if all(c in codes for c in form) else -np.inf for form in r.forms]
                out.append(max(best, default=-np.inf))
            yield df[["reading", "question"]].assign(log_likelihood=[None if x == -np.inf else x for x in out])

    pairs = readings.join(targets.select("exam_id", "question", surface_forms(F.col("segments")).alias("forms")), "exam_id")
    return pairs.select("reading", "question", "frames", "forms").mapInPandas(run, "reading long, question string, log_likelihood double")


def decided(scores: DataFrame, settings) -> DataFrame:
    """(reading, question, probability, margin, outcome): the likeliest target, as resolve.decide names outcomes.

    Probabilities are among the targets; the margin is to the second. Equal likelihoods go to the first question.
    """
    rows = scores.where("log_likelihood is not null").groupBy("reading").agg(F.collect_list(F.struct("log_likelihood", "question")).alias("_all"))
    top = F.array_max(F.transform("_all", lambda x: x["log_likelihood"]))
    share = F.transform("_all", lambda x: F.struct(F.exp(x["log_likelihood"] - top).alias("p"), x["question"].alias("question")))
    rows = rows.withColumn("_all", share).withColumn("_sum", F.aggregate("_all", F.lit(0.0), lambda a, x: a + x["p"]))
    rows = rows.withColumn("_all", F.array_sort("_all", lambda a, b: F.when(a["p"] != b["p"], F.when(a["p"] > b["p"], -1).otherwise(1)).when(a["question"] < b["question"], -1).otherwise(1)))
    best, second = F.col("_all")[0]["p"] / F.col("_sum"), F.coalesce(F.get("_all", F.lit(1))["p"] / F.col("_sum"), F.lit(0.0))
    enough = best >= settings.match_threshold
    outcome = F.when(enough & (best - second >= settings.margin_threshold), "RESOLVED").when(enough, "AMBIGUOUS").otherwise("NO_MATCH")
    return rows.select("reading", F.when(outcome == "RESOLVED", F.col("_all")[0]["question"]).alias("question"), best.alias("probability"), (best - second).alias("margin"), outcome.alias("outcome"))
