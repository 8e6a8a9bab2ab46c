"""Mixing sources to target weights: whole repeats, then a subset whose lengths sum to the rest of the budget."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.llm.shared import materialize, ready, whole_row, word_count

#: Budget that the dynamic program settles at least; twice the longest length, if that is more. It takes 5 bytes a word.
DP_BUDGET = 1 << 16
#: Rows of one length and source that one task ranks.
RANKED_ROWS = 128


def cyclic_weights(sources: list[str | None], cycle: tuple[float, ...] = (3, 1, 2)) -> dict[str | None, float]:
    """Weights that repeat in the order of the sources."""
    return {s: cycle[i % len(cycle)] for i, s in enumerate(sources)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: its weight's part of share * all sizes, stopped at most * its size.

    What is cut off is shared out again by weight, until no source is above its bound.
    """
    left, open_ = share * sum(sizes.values()), dict(weights)
    found: dict[str | None, float] = {}
    while open_:
        whole = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / whole > most * sizes[s]]
        if not over:
            return found | {s: left * w / whole for s, w in open_.items()}
        for s in over:
            found[s] = most * sizes[s]
            left -= found[s]
            del open_[s]
    return found


def _reach(parts: list[tuple[int, int]], goal: int) -> tuple[int, np.ndarray]:
    """(largest sum of parts up to goal, by sum the part that was the last to be needed for it, -1 where none can be).

    parts: length and number taken together. A part is only looked at until goal itself is reached.
    """
    reached, last = np.zeros(goal + 1, bool), np.full(goal + 1, -1, np.int32)
    reached[0] = True
    for i, (n, k) in enumerate(parts):
        size = n * k
        new = np.flatnonzero(reached[: goal + 1 - size] & ~reached[size:]) + size
        reached[new] = True
        last[new] = i
        if reached[goal]:
            break
    return int(np.flatnonzero(reached)[-1]), last


def fit(lengths: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many items of each (length, count) to take so that the lengths sum to budget as nearly as can be, never above.

    Each length first gives its even part, then lengths from the longest down one more each while the rest is large;
    a bounded-knapsack dynamic program over all that remains, whatever its length, settles the rest.
    """
    lengths = sorted((n, c) for n, c in lengths if n > 0)
    whole = sum(n * c for n, c in lengths)
    if budget >= whole:
        return dict(lengths)
    taken = {n: c * budget // whole for n, c in lengths}
    rest = budget - sum(n * k for n, k in taken.items())
    bound = max(DP_BUDGET, 2 * lengths[-1][0]) if lengths else 0
    for n, c in reversed(lengths):
        if rest > bound and (more := min(c - taken[n], (rest - bound // 2) // n)) > 0:
            taken[n] += more
            rest -= more * n
    parts: list[tuple[int, int]] = []  # numbers double, so that any count can be made
    for n, c in lengths:
        count, step = min(c - taken[n], rest // n), 1
        while count > 0:
            parts.append((n, min(step, count)))
            count -= step
            step *= 2
    at, last = _reach(parts, rest)
    while at:
        n, k = parts[last[at]]
        taken[n] += k
        at -= n * k
    return taken


def mix(
    docs: DataFrame, weights: Callable[[list[str | None]], dict[str | None, float]] = cyclic_weights, share: float = 1.5, most: float = 2.0,
    seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of docs: id, size (words), source_size, target (its source's), taken (words, repeats counted), order.

    order: a seeded hash of id and text that tells documents apart, also those that repeat an id or have none.
    weights: from the sources, in code point order with null last, to their weights. Every document is taken
    target // source_size times, and documents chosen by a seeded order once more: fit() says how many of each
    length. A null text has size 0 and is a document of no words; sources without words have target 0; rows that
    repeat are documents of their own; other columns are ignored; an empty table gives an empty one. The driver
    holds one number per source; a task holds one row per distinct length of a source.
    """
    spark = docs.sparkSession
    ready(spark)
    named = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), _order(seed, id_col, text_col)]
    sized = materialize(docs.select(*named, word_count(F.col(f"`{text_col}`")).alias("size")), "sizes")
    histogram = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("rows")), "lengths")
    sizes = {r.source: r.words for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words")).collect()}
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = targets(sizes, weights(sources), share, most)

    def plan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        source = None if pd.isna(key[0]) else key[0]
        size, aim = sizes[source], aims[source]
        base = int(aim // size) if size else 0
        wanted = fit(list(zip(rows["size"].tolist(), rows["rows"].tolist(), strict=True)), round(aim - base * size))
        found = {"p_source": [source] * len(rows), "p_size": rows["size"], "rows": rows["rows"], "more": [wanted.get(n, 0) for n in rows["size"]]}
        return pd.DataFrame(found | {"source_size": size, "target": float(aim), "base": base})

    kinds = "p_source string, p_size long, rows long, more long, source_size long, target double, base long"
    planned = materialize(histogram.groupBy("source").applyInPandas(plan, kinds), "plan")
    both = sized.join(planned, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    # some of a length are chosen: rank them in parts of about RANKED_ROWS rows, in the order of their hashes
    part = F.floor((F.col("order") / 2.0**64 + 0.5) * F.ceil(F.col("rows") / RANKED_ROWS)).cast("long")
    some = both.filter("more > 0 and more < rows").withColumn("part", part)
    before = F.sum("n").over(Window.partitionBy("p_source", "p_size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = some.groupBy("p_source", "p_size", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    parts = materialize(parts, "parts")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("p_source", "p_size", "part").orderBy("order", "id")))
    own = parts.select(F.col("p_source").alias("q_source"), F.col("p_size").alias("q_size"), F.col("part").alias("q_part"), "before")
    same = F.col("p_source").eqNullSafe(F.col("q_source")) & (F.col("p_size") == F.col("q_size")) & (F.col("part") == F.col("q_part"))
    columns = [F.col("id").alias(id_col), "size", "source_size", "target"]
    once_more = F.col("rank") + F.col("before") <= F.col("more")
    chosen = ranked.join(own, same).select(*columns, ((F.col("base") + once_more.cast("long")) * F.col("size")).alias("taken"), "order")
    every = (F.col("base") + (F.col("more") > 0).cast("long")) * F.col("size")
    return both.filter("more = 0 or more = rows").select(*columns, every.alias("taken"), "order").unionByName(chosen)


def _order(seed: int, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("order")


def repeat(docs: DataFrame, mixed: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs as often as mixed = mix(docs) takes them; documents of no words, which cost nothing, stay once.

    Rows are told apart by id and text; of rows that repeat both, under one source or several, all copies that the mix
    takes are spread over these rows, so that the sum is the mix's. seed: that of the mix.
    """
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(1))
    taken = mixed.groupBy(F.col(id_col).alias("own_id"), F.col("order").alias("own_order")).agg(F.sum(times).alias("times"), F.count("*").alias("rows"))
    taken = materialize(taken.filter("times > 0"), "taken")
    own = docs.select(whole_row(docs), F.col(f"`{id_col}`").alias("id"), _order(seed, id_col, text_col))
    joined = own.join(taken, (F.col("order") == F.col("own_order")) & F.col("id").eqNullSafe(F.col("own_id")))
    nth = F.row_number().over(Window.partitionBy("order", "id").orderBy("order"))
    part = F.expr("times div rows") + (nth <= F.col("times") % F.col("rows")).cast("long")
    several = joined.filter("rows > 1").select("row", part.alias("times")).filter("times > 0")
    both = joined.filter("rows = 1").select("row", "times").unionByName(several)
    copies = both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return copies.select(*(F.col(f"row.`{c}`") for c in docs.columns))
