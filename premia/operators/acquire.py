"""Acquisition: scores of candidates, their combination, policies, and the greedy choice of a spread-out batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.errors import AdvisorError
from premia.functions.numeric import rounded
from premia.operators.encode import bin_ids, scaled_one_hot
from premia.operators.evaluate import normalized
from premia.schema import OUTER_BOUNDS

# Weights of the scores, of spread in the greedy choice, share of focused rows, breakpoints, policies.
WEIGHTS = {"uncertainty": 0.10, "residual": 0.05, "breakpoint": 0.20, "diversity": 0.65}
GREEDY_SPREAD, FOCUSED = 0.50, 0.30
BREAKPOINTS = {"driver_age": (21.0, 25.0, 35.0, 60.0), "years_licensed": (3.0,), "annual_km": (12000.0,), "excess": (600.0,)}
DECAY = 40.0
POLICIES = {
    "balanced": (0.70, 0.30, 0.20),
    "uncertainty": (0.85, 0.15, 0.20),
    "residual": (0.55, 0.45, 0.20),
    "explore": (0.60, 0.20, 0.40),
    "exploit": (0.80, 0.20, 0.10),
}
BOOSTS, MOST_BOOSTS = (1.1, 1.25), 3
DIMS = 23
#: Differences that a block of nearest() holds.
BLOCK_CELLS = 1 << 20
#: What gives one finite score, the larger the better, for each candidate: a column of the scores' table.
AcquisitionScore = Callable[[DataFrame], Column]


def with_vector(rows: DataFrame) -> DataFrame:
    return rows.select("*", *scaled_one_hot())


def nearest(candidates: DataFrame, anchors: DataFrame, anchor_id: str, *carried: str, most: int = 20_000) -> DataFrame:
    """quote_id of each candidate with the distance to its nearest anchor, that anchor's id and carried columns.

    Both sides have vectors (with_vector). Anchors are the rows of a split or of the mapping so far, whose budgets the
    configuration bounds and a run passes as `most`; more raise an error, and those that there are go to every task. Ties
    go to the smaller id. Candidates are compared block by block, in blocks that hold BLOCK_CELLS distances, and aren't
    shuffled.
    """
    names = [f"v{i:02d}" for i in range(DIMS)]
    held = anchors.select(anchor_id, *names, *carried).limit(most + 1).toPandas().sort_values(anchor_id, ignore_index=True)
    if len(held) > most:
        raise ValueError(f"more than {most} anchors; raise `most` if executors can hold them")
    points = held[names].to_numpy()
    ids, more = held[anchor_id].to_numpy(), {c: held[c].to_numpy() for c in carried}
    rows = max(1, BLOCK_CELLS // max(1, points.size))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch) if len(points) else 0, rows):
                part = batch.iloc[at : at + rows]
                gaps = np.sqrt(((part[names].to_numpy()[:, None, :] - points[None, :, :]) ** 2).sum(2))
                best = gaps.argmin(1)
                found = {"quote_id": part["quote_id"].to_numpy(), "distance": gaps[np.arange(len(part)), best], "anchor_id": ids[best]}
                yield pd.DataFrame(found | {c: v[best] for c, v in more.items()})

    kinds = "".join(f", {c} double" for c in carried)
    return candidates.select("quote_id", *names).mapInPandas(search, f"quote_id long, distance double, anchor_id long{kinds}")


def breakpoint_score() -> Column:
    """Sum over the fields of exp(-DECAY * distance to the nearest breakpoint / range), not yet scaled."""
    total = F.lit(0.0)
    for name, points in BREAKPOINTS.items():
        low, high = OUTER_BOUNDS[name]
        gaps = [F.abs(F.col(name).cast("double") - p) for p in points]
        gap = F.least(*gaps) if len(gaps) > 1 else gaps[0]
        total = total + F.exp(F.lit(-DECAY) * (gap / max(float(high - low), 1.0)))
    return total


def combined(scores: DataFrame, weights: Mapping[str, float] = WEIGHTS, components: Mapping[str, AcquisitionScore] | None = None) -> DataFrame:
    """scores (quote_id and a column for each weight) scaled, weighted and scaled again: quote_id, score.

    components: scores of one's own by name, each a function of the table that gives a Column; a weight without a column
    or a component raises. The table, a candidate pool, is kept while it is asked for its bounds and then its rows.
    """
    own = dict(components or {})
    if missing := sorted(set(weights) - set(scores.columns) - set(own)):
        raise ValueError(f"no score for the weights of {', '.join(missing)}")
    whole = sum(weights.values())
    held = scores.withColumns({n: f(scores).cast("double") for n, f in own.items() if n in weights}).select("quote_id", *weights).persist()
    scaled = normalized(held, *weights)
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col(name) * (w / whole)
    return normalized(scaled.select("quote_id", total.alias("score")), "score")


def check_boosts(boosts: Mapping[str, float], allowed: set[str]) -> None:
    if len(boosts) > MOST_BOOSTS or not set(boosts.values()) <= set(BOOSTS):
        raise AdvisorError(f"at most {MOST_BOOSTS} boosts of {BOOSTS}")
    if unknown := set(boosts) - allowed:
        raise AdvisorError(f"no such bin: {', '.join(sorted(unknown))}")


def policy_scores(rows: DataFrame, policy: str, boosts: Mapping[str, float]) -> DataFrame:
    """rows (quote columns, uncertainty, residual) to quote_id, factor, score.

    The policy's weighted sum is scaled, multiplied by the largest boost among the row's bins, and scaled again.
    """
    u, r, _ = POLICIES[policy]
    scaled = normalized(rows, "uncertainty", "residual").withColumn("base", F.col("uncertainty") * u + F.col("residual") * r)
    factor = F.lit(1.0)
    for bin_id, boost in boosts.items():
        factor = F.greatest(factor, F.when(F.array_contains(bin_ids(), bin_id), F.lit(boost)).otherwise(F.lit(1.0)))
    based = normalized(scaled.select("quote_id", "base", factor.alias("factor")), "base")
    return normalized(based.withColumn("score", F.col("base") * F.col("factor")), "score").select("quote_id", "factor", "score")


def exploration_count(count: int, policy: str) -> int:
    return min(count, max(0, round(count * POLICIES[policy][2])))


def focused_count(count: int, fraction: float = FOCUSED) -> int:
    return max(1, min(count, round(count * fraction)))


def greedy(scores: np.ndarray, vectors: np.ndarray, count: int, spread: float = GREEDY_SPREAD) -> list[int]:
    """Positions chosen one by one: the largest (1 - spread) * score + spread * scaled distance to those chosen.

    The first is the largest score; ties go to the smaller position. Distances are kept up to date, not computed anew.
    """
    chosen: list[int] = []
    near = np.full(len(scores), np.inf)
    total = scores.astype(float).copy()
    for _ in range(min(count, len(scores))):
        total[chosen] = -np.inf
        best = int(total.argmax())
        chosen.append(best)
        near = np.minimum(near, np.sqrt(((vectors - vectors[best]) ** 2).sum(1)))
        low, high = near.min(), near.max()
        total = (1 - spread) * scores + spread * ((near - low) / (high - low) if high > low else np.zeros(len(near)))
    return chosen


def greedy_batch(scored: DataFrame, count: int, spread: float = GREEDY_SPREAD) -> DataFrame:
    """rank and quote_id of the rows that greedy() chooses from one candidate pool (quote_id, score, v00..v22).

    The choice is sequential; a pool has the size that the configuration names and is one group.
    """

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("quote_id")
        at = greedy(pool["score"].to_numpy(), pool[[f"v{i:02d}" for i in range(DIMS)]].to_numpy(), count, spread)
        return pd.DataFrame({"rank": range(len(at)), "quote_id": pool["quote_id"].to_numpy()[at]})

    return scored.groupBy(F.lit(0).alias("pool")).applyInPandas(choose, "rank long, quote_id long")


def diagnostic_bins(candidates: DataFrame, validation: DataFrame, catalogue: DataFrame) -> DataFrame:
    """bin_id, candidate_count, validation_count, mean uncertainty and mean residual; 0 for empty bins.

    candidates have `uncertainty`, validation rows `residual`, both scaled to 0..1; catalogue: bin_id.
    """
    def by_bin(rows: DataFrame, value: str, count: str) -> DataFrame:
        return rows.select(F.explode(bin_ids()).alias("bin_id"), value).groupBy("bin_id").agg(F.count("*").alias(count), F.avg(value).alias(value))

    found = catalogue.join(by_bin(candidates, "uncertainty", "candidate_count"), "bin_id", "left").join(by_bin(validation, "residual", "validation_count"), "bin_id", "left")
    zero = F.lit(0).cast("long")
    return found.select("bin_id", F.coalesce("candidate_count", zero).alias("candidate_count"), F.coalesce("validation_count", zero).alias("validation_count"), rounded(F.coalesce("uncertainty", F.lit(0.0))).alias("uncertainty"), rounded(F.coalesce("residual", F.lit(0.0))).alias("residual"))
