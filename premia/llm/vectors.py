"""Near-duplicate embeddings: spherical k-means cells, blocked cosines within cells, one representative per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.components import connected_components
from premia.llm.shared import materialize, ready

#: Vectors that the cells are learned from, at most about so many; those that a cell is learned from at least; rounds of
#: k-means; nodes of a label up to which it is one cell.
SAMPLE, LEARNED_FROM, ROUNDS, ONE_CELL = 40_000, 8, 10, 1024
#: Home rows of one task; rows compared with them at once.
HOME_ROWS, BLOCK_ROWS = 4096, 1024


def units_of(rows: np.ndarray) -> np.ndarray:
    """Finite rows, none of them zero, at length 1; scaled first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True, initial=0.0)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _units(arrays: pa.Array) -> np.ndarray:
    """units_of vectors of one dimension."""
    flat = arrays.flatten().to_numpy(zero_copy_only=False)
    return units_of(flat.reshape(len(arrays), -1)) if len(arrays) else np.zeros((0, 0))


def centroids(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit rows: `cells` unit centroids, or fewer if there are fewer rows."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    found = sample[np.sort(rng.choice(len(sample), cells, replace=False))]
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[at : at + BLOCK_ROWS] @ found.T).argmax(1) for at in range(0, len(sample), BLOCK_ROWS)])
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), found)
    return found


def homes_of(units: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell with the nearest centroid, cosine to each centroid) of each row; the same bits for a row in any batch."""
    dots = np.einsum("ij,kj->ik", units, centers)
    return dots.argmax(1), dots


def visits_of(
    home: np.ndarray, dots: np.ndarray, centers: np.ndarray, least: np.ndarray, cosine: float, slack: float = 1e-6
) -> list[np.ndarray]:
    """For each row the later cells in which a vector with that cosine or more to it may be at home.

    least: the smallest cosine of a cell's own rows to its centroid. Two bounds hold for a linked y at home in c:

    * y = cos t * x + sin t * u with u at a right angle to x lies nearer to c than to x's home h only if
      x.(h - c) <= tan t * |(c - h) less its part along x|;
    * the angle from x to c is at most that from y to c, so at most the cell's radius, and t.

    Cells have an order, and of two linked rows that of the earlier cell visits the later one.
    """
    best = dots[np.arange(len(home)), home]
    gap = best[:, None] - dots
    apart = np.maximum(2 - 2 * centers[home] @ centers.T, 0)
    reach = np.sqrt(np.maximum(apart - gap**2, 0)) * (math.sqrt(1 - cosine**2) / cosine)
    radius = np.arccos(np.clip(least, -1, 1)) + math.acos(cosine)
    may = (gap <= reach + slack) & (dots >= np.cos(np.minimum(radius, math.pi)) - slack)
    may &= np.arange(len(centers)) > home[:, None]
    return [np.flatnonzero(row) for row in may]


def compare(
    home: np.ndarray, others: np.ndarray, home_weight: np.ndarray, weight: np.ndarray, cosine: float
) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(linked weight of each home row, of each other row, a forest that joins what is linked).

    Home rows are compared with each other, themselves included, and with the others; the others aren't compared among
    each other. In the forest's pairs, positions count the home rows first and the others after them.
    """
    rows, weights = np.concatenate([home, others]), np.concatenate([home_weight, weight])
    found = np.zeros(len(rows), np.int64)
    root = np.arange(len(rows))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    forest = []
    for h in range(0, len(home), BLOCK_ROWS):
        end = min(h + BLOCK_ROWS, len(home))
        own = [(a, min(a + BLOCK_ROWS, len(home))) for a in range(h, len(home), BLOCK_ROWS)]
        for start, stop in [*own, *((a, a + BLOCK_ROWS) for a in range(len(home), len(rows), BLOCK_ROWS))]:
            linked = rows[h:end] @ rows[start:stop].T >= cosine
            found[h:end] += linked @ weights[start:stop]
            if start != h:
                found[start:stop] += weights[h:end] @ linked
            for j in np.flatnonzero(linked.any(0)):
                tree = top(start + int(j))
                for i in np.unique(root[h + np.flatnonzero(linked[:, j])]):
                    if (other := top(int(i))) != tree:
                        root[other] = tree
                        forest.append((other, tree))
    return found[: len(home)], found[len(home) :], forest


def _centers(nodes: DataFrame) -> dict[tuple, np.ndarray]:
    """Centroids of each (label, dimension) of more than ONE_CELL nodes: about sqrt(nodes) / 2, as far as the sample goes."""
    large = {(r.label, r.dim): r.n for r in nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).filter(F.col("n") > ONE_CELL).collect()}
    if not large:
        return {}
    share = min(1.0, SAMPLE / sum(large.values()))
    named = nodes.sparkSession.createDataFrame(list(large), nodes.select("label", "dim").schema)
    drawn = nodes.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    held = drawn.join(F.broadcast(named), ["label", "dim"]).select("label", "dim", "key", "v").toArrow().sort_by([("key", "ascending")])
    found = {}
    for (label, dim), n in large.items():
        own = held.filter((pc.field("label") == label) & (pc.field("dim") == dim))
        cells = min(round(math.sqrt(n) / 2), len(own) // LEARNED_FROM)
        if cells > 1:
            found[label, dim] = centroids(_units(own["v"].combine_chunks()), cells)
    return found


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id_col, n_links (other vectors linked directly), component_id, kept (id = component_id).

    Vectors are linked where their labels are equal and not null and their cosine, in double precision, is `cosine`
    or more. Equal vectors of a label are one node with a weight, by its smallest id. Each label of more than ONE_CELL
    nodes gets cells of its own by k-means on its part of about SAMPLE vectors: sqrt(nodes) / 2, but no more than one for
    LEARNED_FROM vectors of the sample. Every node is at home in the cell of its nearest centroid and visits each later
    cell in which a linked vector can be at home, so that no link is lost and a pair is compared once. Within label and
    cell, blocks of home rows are compared with the home rows of this and later blocks and with all visitors; tasks hold
    HOME_ROWS home rows and report link counts and a forest, not pairs. Null, zero and non-finite vectors are linked with
    nothing; vectors of other dimensions are never linked. A null id joins the node of an equal vector. Other columns
    are ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    ready(spark)
    single = vectors.select(F.col(f"`{vector_col}`").alias("v")).schema["v"].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(kind).alias("v"), F.col(f"`{label_col}`").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    # two hashes tell vectors apart; components of -0.0 count as 0.0
    same = F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    key = F.when(fine, F.concat_ws(":", *(F.xxhash64(F.lit(i), "label", same).cast("string") for i in range(2))))
    rows = materialize(rows.withColumn("key", key), "vectors")
    first = [F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"), F.first("label").alias("label")]
    grouped = rows.filter("key is not null").groupBy("key").agg(*first)
    # a number of its own for each node, as different vectors may repeat an id
    nodes = materialize(grouped.withColumns({"dim": F.size("v"), "node": F.monotonically_increasing_id()}), "nodes")
    centers = _centers(nodes)
    label = rows.schema["label"].dataType.simpleString()

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                keys = list(zip(part.column("label").to_pylist(), part.column("dim").to_pylist(), strict=True))
                for one in dict.fromkeys(keys):
                    yield one, part.take(pa.array([i for i, k in enumerate(keys) if k == one], pa.int64()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, part in parted(batches):
            if one in centers:
                home, dots = homes_of(_units(part.column("v")), centers[one])
                columns = [part.column("label"), part.column("dim"), pa.array(home, pa.int64()), pa.array(dots.max(1))]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "cell", "dot"])

    least_dots = {one: np.ones(len(c)) for one, c in centers.items()}
    if centers:
        measured = nodes.mapInArrow(measure, f"label {label}, dim int, cell long, dot double")
        for r in measured.groupBy("label", "dim", "cell").agg(F.min("dot").alias("dot")).collect():
            least_dots[r.label, r.dim][r.cell] = r.dot

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "weight", "v", "label", "dim"]
        for one, part in parted(batches):
            home, more = np.zeros(part.num_rows, np.int64), [np.zeros(0, np.int64)] * part.num_rows
            if one in centers:
                home, dots = homes_of(_units(part.column("v")), centers[one])
                more = visits_of(home, dots, centers[one], least_dots[one], cosine)
            take = np.concatenate([np.arange(part.num_rows), np.repeat(np.arange(part.num_rows), [len(x) for x in more])])
            cell = np.concatenate([home, *more])
            out = part.select(names).take(pa.array(take))
            visits = pa.array(np.arange(len(take)) >= part.num_rows)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell, pa.int64()), visits], names=[*names, "cell", "visits"])

    group = ["label", "dim", "cell"]
    placed = materialize(nodes.mapInArrow(assign, f"node long, weight long, v {kind}, label {label}, dim int, cell long, visits boolean"), "cells")
    sizes = placed.filter("not visits").groupBy(*group).agg(F.ceil(F.count("*") / HOME_ROWS).alias("blocks"))
    own = placed.join(materialize(sizes, "cell_sizes"), group).withColumn("home", F.when(~F.col("visits"), F.pmod(F.xxhash64("node"), F.col("blocks"))))
    # a home row meets its own block and the earlier ones, a visitor all
    tasks = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("home", F.col("blocks") - 1))))

    def within(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        mine = (rows["home"] == key[3]).to_numpy()
        if not mine.any():  # by its hash, no home row fell into the block
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        units = units_of(np.stack(rows["v"].to_numpy()))
        ids, weight = rows["node"].to_numpy(), rows["weight"].to_numpy()
        counts, reached, forest = compare(units[mine], units[~mine], weight[mine], weight[~mine], cosine)
        both, totals = np.concatenate([ids[mine], ids[~mine]]), np.concatenate([counts, reached])
        ends = np.array(forest, np.int64).reshape(-1, 2)
        links = pd.DataFrame({"a": both[ends[:, 0]], "b": both[ends[:, 1]], "links": -1})
        return pd.concat([links, pd.DataFrame({"a": both, "b": both, "links": totals})[totals > 0]])

    found = materialize(tasks.groupBy(*group, "block").applyInPandas(within, "a long, b long, links long"), "links")
    parts = connected_components(found.filter("links < 0").select("a", "b"))
    counts = found.filter("links >= 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    reps = nodes.select("node", "rep")
    least = parts.join(reps, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    parts = parts.join(least, "component").select("node", "component_id")
    judged = nodes.select("key", "node", "rep", "weight").join(counts, "node", "left").join(parts, "node", "left")
    # a node is linked to itself, so that its own rows but one count
    links = (F.coalesce("links", "weight") - 1).alias("n_links")
    judged = materialize(judged.select("key", F.coalesce("component_id", "rep").alias("component_id"), links), "judged")
    out = rows.select("id", "key").join(judged, "key", "left")
    links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    out = out.select(F.col("id").alias(id_col), links, F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
