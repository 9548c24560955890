"""Weighted edit distance from observed to expected text, and what follows from it, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.config import Resolution


def folded_costs(confusions: tuple[tuple[str, str, float], ...]) -> tuple[dict[str, float], dict[str, float]]:
    """(substitutions by observed + expected character, deletions), lower-cased, the least cost of each."""
    substitute: dict[str, float] = {}
    delete: dict[str, float] = {}
    for observed, expected, cost in confusions:
        into, at = (substitute, observed.lower() + expected.lower()) if expected else (delete, observed.lower())
        into[at] = min(cost, into.get(at, cost))
    return substitute, delete


def _map(costs: dict[str, float]) -> Column:
    if not costs:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*(F.lit(x) for pair in costs.items() for x in pair))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def weighted_distance(observed: Column, target: Column, settings: Resolution) -> Column:
    """Row by row over the observed characters; the costs are looked up in two literal maps.

    It is read by every pair of texts once: score distinct texts, not observations.
    """
    substitute, delete = folded_costs(settings.confusions)
    subs, dels = _map(substitute), _map(delete)
    insert = F.lit(float(settings.insert_cost))
    wanted = _characters(F.lower(target))
    first = F.transform(F.sequence(F.lit(0), F.size(wanted)), lambda j: j * insert)

    def step(row: Column, seen: Column) -> Column:
        drop = F.coalesce(F.try_element_at(dels, seen), F.lit(float(settings.delete_cost)))
        start = F.struct(F.array(row[0] + drop).alias("row"), F.lit(1).alias("j"))

        def cell(acc: Column, want: Column) -> Column:
            other = F.coalesce(F.try_element_at(subs, F.concat(seen, want)), F.lit(float(settings.substitute_cost)))
            change = F.when(seen == want, F.lit(0.0)).otherwise(other)
            j = acc["j"]
            value = F.least(row[j] + drop, acc["row"][j - 1] + insert, row[j - 1] + change)
            return F.struct(F.concat(acc["row"], F.array(value)).alias("row"), (j + 1).alias("j"))

        return F.aggregate(wanted, start, cell)["row"]

    return F.element_at(F.aggregate(_characters(F.lower(observed)), first, step), -1)


def similarity(observed: Column, target: Column, settings: Resolution) -> Column:
    longest = F.greatest(F.length(observed), F.length(target), F.lit(1))
    value = F.greatest(F.lit(0.0), 1 - weighted_distance(observed, target, settings) / longest)
    return F.when((observed == "") & (target == ""), F.lit(1.0)).otherwise(value)


def calibrated(raw: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through points (ascending), constant beyond them; unchanged without points."""
    if not points:
        return raw
    out = F.when(raw <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x1 > x0:
            out = out.when(raw <= x1, y0 + (raw - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(points[-1][1])))


#: Costs that a re-estimated confusion may have.
LEAST_COST, MOST_COST = 0.1, 1.0
ALIGNED = "observed string, expected string"


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Characters of observed and expected texts side by side on a cheapest path of unit costs; '' for none."""
    for df in batches:
        out: list[tuple[str, str]] = []
        for seen, wanted in zip(df["observed"], df["expected"]):
            seen, wanted = (seen or "").lower(), (wanted or "").lower()
            costs = [list(range(len(wanted) + 1))]
            for i, c in enumerate(seen, 1):
                row = [i]
                for j, d in enumerate(wanted, 1):
                    row.append(min(costs[-1][j - 1] + (c != d), costs[-1][j] + 1, row[-1] + 1))
                costs.append(row)
            i, j = len(seen), len(wanted)
            while i or j:
                if i and j and costs[i][j] == costs[i - 1][j - 1] + (seen[i - 1] != wanted[j - 1]):
                    i, j = i - 1, j - 1
                    out.append((seen[i], wanted[j]))
                elif i and costs[i][j] == costs[i - 1][j] + 1:
                    i -= 1
                    out.append((seen[i], ""))
                else:
                    j -= 1
                    out.append(("", wanted[j]))
        yield pd.DataFrame(out, columns=["observed", "expected"])


def estimated_confusions(pairs: DataFrame, least: int = 5) -> DataFrame:
    """(observed, expected, n, cost) from pairs of texts (observed, expected): how often a character was read for another.

    The cost falls from MOST_COST as the share of the observed character that meant the other grows. Equal characters,
    characters that were missed and pairs seen fewer times than least are left out. Equal pairs are counted once and
    weighed by their number, so texts are aligned once each.
    """
    distinct = pairs.groupBy("observed", "expected").agg(F.count(F.lit(1)).alias("_n"))
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for n, own in df.groupby("_n"):
                for part in _aligned(iter([own])):
                    yield part.assign(n=int(n))

    found = distinct.mapInPandas(run, f"{ALIGNED}, n long").where("observed <> ''")
    counts = found.groupBy("observed", "expected").agg(F.sum("n").alias("n"))
    total = counts.groupBy("observed").agg(F.sum("n").alias("_all"))
    share = F.col("n") / F.col("_all")
    cost = F.round(F.greatest(F.lit(LEAST_COST), F.lit(MOST_COST) - share), 2)
    rows = counts.join(total, "observed").where((F.col("observed") != F.col("expected")) & (F.col("n") >= least))
    return rows.select("observed", "expected", "n", cost.alias("cost"))
