"""Near-duplicates by MinHash with tensored banding, verified on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm import bloom
from premia.llm.components import connected_components
from premia.llm.shared import blocks, materialize, ready, small_batches, trimmed, whole_row

#: Minhashes of a half-band, and how likely a pair that just reaches the threshold may share no table's key.
HASHES, MISS = 3, 5e-5
#: Shingles and documents that one task compares at most, but for one document that alone has more.
TASK_SHINGLES, TASK_ROWS = 500_000, 512

_rng = np.random.default_rng(20)
_SALTS = [np.uint64(x) for x in _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)]


def shingles(text: str, width: int = 5) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; words are split at ASCII white space and A-Z lower-cased.

    Fewer words than width make one shingle; no words, none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(width, len(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    mixed = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        mixed = (mixed ^ hashes[i : len(words) - n + 1 + i]) * _SALTS[i % len(_SALTS)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def halves_for(percent: int) -> int:
    """Half-bands of a collection, the fewest that MISS allows at the threshold: 12 for 85, 15 for 80.

    A pair of similarity s has no equal half-band in a collection with probability (1 - s^HASHES)^halves, and shares
    a key if it has one in both.
    """
    agree = (percent / 100) ** HASHES
    return 1 if agree >= 1 else math.ceil(math.log1p(-math.sqrt(1 - MISS)) / math.log1p(-agree))


@cache
def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What n minhashes are made with."""
    rng = np.random.default_rng(21)
    return rng.integers(0, 2**64, (n, 1), np.uint64), rng.integers(0, 2**64, (n, 1), np.uint64) | np.uint64(1)


def halves(found: np.ndarray, n: int) -> list[int]:
    """Two collections of n half-bands, each of HASHES minhashes, as signed 64-bit numbers."""
    xor, times = _constants(2 * n * HASHES)
    least = np.full(len(xor), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        least = np.minimum(least, ((found[at : at + 512] ^ xor) * times).min(1))
    mixed = np.zeros(2 * n, np.uint64)
    for i, own in enumerate(least.reshape(-1, HASHES).T):
        mixed = (mixed ^ own) * _SALTS[i]
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64).tolist()


def _sketch(docs: DataFrame, width: int, n: int) -> DataFrame:
    """id, mark, n_shingles, set (digest of the shingle set, null if empty), h0, h1, ... (half-bands)."""
    names = [f"h{i}" for i in range(2 * n)]
    schema = pa.schema([("n_shingles", pa.int64()), ("set", pa.binary()), *((h, pa.int64()) for h in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                rows = []
                for text in block.column("text").to_pylist():
                    found = shingles(text or "", width)
                    rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), *halves(found, n)) if len(found) else (0, None, *[None] * len(names)))
                columns = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([block.column("id"), block.column("mark"), *columns], names=["id", "mark", *schema.names])

    return docs.mapInArrow(trimmed(run), f"id long, mark long, n_shingles long, set binary, {', '.join(f'{h} long' for h in names)}")


def links_within(sets: list[np.ndarray], percent: int, apart: int | None = None) -> np.ndarray:
    """The smallest position that each set is linked to, through any number of links.

    Two sets are linked where 100 * common >= percent * union. Common shingles are counted for a set against all
    earlier ones at once, through the lists of sets that hold each shingle; pairs already joined need no test. apart:
    only the sets from that position on are compared, and only with those before it.
    """
    sizes = np.array([len(s) for s in sets])
    first = len(sets) if apart is None else apart
    owner = np.repeat(np.arange(first), sizes[:first])
    values = np.concatenate([*sets[:first], np.zeros(0, np.uint64)])
    order = np.argsort(values, kind="stable")  # of equal shingles, owners ascend
    values, holders = values[order], owner[order]
    if apart is None:
        place, ends = np.empty(len(order), np.int64), np.cumsum(sizes)
        place[order] = np.arange(len(order))
        lists = np.searchsorted(values, values, side="left")
    root = np.arange(len(sets))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(1 if apart is None else apart, len(sets)):
        most = min(i, first)
        if apart is None:  # earlier holders of each of its shingles
            at = place[ends[i] - sizes[i] : ends[i]]
            starts, spans = lists[at], at - lists[at]
        else:
            starts = np.searchsorted(values, sets[i], side="left")
            spans = np.searchsorted(values, sets[i], side="right") - starts
        total = int(spans.sum())
        if not total:
            continue
        before = np.repeat(starts - np.cumsum(spans) + spans, spans) + np.arange(total)
        common = np.bincount(holders[before], minlength=most)
        for j in np.unique(root[np.flatnonzero(100 * common >= percent * (sizes[i] + sizes[:most] - common))]):
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(len(sets))], np.int64)


@dataclass(frozen=True)
class _Judged:
    """rows: id, mark, n_shingles and set of each row; classes: node, set, rep, rep_mark; parts: node, part (component of nodes)."""

    rows: DataFrame
    classes: DataFrame
    parts: DataFrame


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mark (a hash of the text; with the id, it tells rows apart) and text."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _judge(texts: DataFrame, percent: int, width: int) -> _Judged:
    """Sketches, classes of equal sets, candidate groups and what exact comparison leaves of them."""
    n = halves_for(percent)
    with small_batches(texts.sparkSession):
        sketches = materialize(_sketch(texts, width, n), "sketches")
    names = [f"h{i}" for i in range(2 * n)]
    # the smallest id first, null last; equal sets have equal half-bands
    least = F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("least")
    grouped = sketches.filter("set is not null").groupBy("set").agg(least, *(F.first(c).alias(c) for c in ("n_shingles", *names)))
    rep = [F.col("least.id").alias("rep"), F.col("least.mark").alias("rep_mark")]
    classes = grouped.select(F.monotonically_increasing_id().alias("node"), "set", *rep, "n_shingles", *names)
    classes = materialize(classes, "classes")
    candidates = materialize(_candidates(classes, names, n), "candidates")
    linked = _verify(texts, classes.select("node", "rep", "rep_mark", "n_shingles"), candidates, percent, width)
    return _Judged(sketches.select("id", "mark", "n_shingles", "set"), classes, connected_components(linked).withColumnRenamed("component", "part"))


def _candidates(classes: DataFrame, names: list[str], n: int) -> DataFrame:
    """(a, b): classes that share a key, as stars around the smallest node of each key.

    A key is a half-band of the first collection with one of the second. Half-bands that one class alone has are
    dropped first, so that tables are filled only with keys that can be shared.
    """
    each = classes.select("node", F.posexplode(F.array(*names)).alias("i", "half"))
    halves_ = each.select("node", (F.col("i") < n).alias("left"), F.xxhash64("i", "half").alias("half"))
    common = materialize(halves_.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half"), "halves")
    sides = [F.collect_set(F.when(F.col("left") == side, F.col("half"))).alias(name) for side, name in ((True, "own"), (False, "other"))]
    held = halves_.join(common, "half").groupBy("node").agg(*sides).select("node", F.explode("own").alias("own"), "other")
    pairs = held.select("node", "own", F.explode("other").alias("other"))
    keys = materialize(pairs.select("node", F.xxhash64("own", "other").alias("key")), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1").select("key", "least")
    return keys.join(materialize(shared, "shared"), "key").filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def near_groups(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id that links reach), kept (id = component_id).

    Documents are linked where 100 * common shingles >= percent * all shingles of both. Each document gets two
    collections of halves_for(percent) half-bands; every pair of one from each makes a table's key, so that few
    minhashes fill many tables. Equal sets are one class. Classes that share a key are compared exactly on whole sets,
    first with the smallest of their key; what that leaves apart within a group of candidates is then compared in
    tasks of at most TASK_SHINGLES shingles and TASK_ROWS documents, for each pair of blocks. What is linked is
    reported as a forest; no pair within a group is emitted, none is capped. Null, empty and blank texts have no
    shingles and are linked with nothing. Rows that repeat an id are each judged by their own text; a null id joins
    its text's class and is no smallest id while there is another. Other columns are ignored; an empty table gives an
    empty one.
    """
    ready(docs.sparkSession)
    judged = _judge(_texts(docs, id_col, text_col), percent, width)
    reps = judged.classes.select("node", "rep")
    least = judged.parts.join(reps, "node").groupBy("part").agg(F.min("rep").alias("least"))
    least = judged.parts.join(least, "part").select("node", "least")
    found = judged.classes.select("set", "node", "rep").join(least, "node", "left")
    found = found.select("set", F.coalesce("least", "rep").alias("component_id"))
    rows = judged.rows.join(materialize(found, "found"), "set", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return rows.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group that near_groups links, one row.

    It is the row with the smallest id, null last, and of rows with that id one with the smallest hash of its text;
    of rows that repeat both, any one. Rows without shingles all stay. Only texts that a Bloom filter of the rows that
    may go lets through are shuffled.
    """
    ready(docs.sparkSession)
    judged = _judge(_texts(docs, id_col, text_col), percent, width)
    parts = judged.parts.join(judged.classes.select("node", "rep", "rep_mark"), "node")
    first = parts.groupBy("part").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "rep_mark", "node")).alias("first"))
    stays = parts.join(first, "part").select("node", (F.col("node") == F.col("first.node")).alias("stays"))
    classes = judged.classes.select("set", "node", "rep", "rep_mark").join(stays, "node", "left")
    # rows by (id, mark): those that go, and those that stay once though there are several
    counted = judged.rows.filter("set is not null").groupBy("set", "id", "mark").agg(F.count("*").alias("n"))
    stands = F.col("id").eqNullSafe(F.col("rep")) & (F.col("mark") == F.col("rep_mark"))
    own = counted.join(classes, "set").withColumn("stays", F.coalesce("stays", F.lit(True)) & stands)
    odd = own.filter("not stays or n > 1").select(F.col("id").alias("odd_id"), F.col("mark").alias("odd_mark"), "stays")
    odd = materialize(odd, "odd")
    bits = bloom.filter_bits(odd.count())
    held = materialize(bloom.holding(odd, F.struct("odd_id", "odd_mark"), bits), "odd_filter")
    rows = docs.select(whole_row(docs), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"))
    flagged = bloom.flag(rows, F.struct("id", "mark"), held, bits, "maybe")
    same_row = F.col("id").eqNullSafe(F.col("odd_id")) & (F.col("mark") == F.col("odd_mark"))
    some = flagged.filter("maybe").join(odd, same_row, "left")
    once = some.filter("stays").groupBy("id", "mark").agg(F.first("row").alias("row"))
    kept = flagged.filter("not maybe").select("row").unionByName(some.filter("stays is null").select("row")).unionByName(once.select("row"))
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns))


def _verify(texts: DataFrame, classes: DataFrame, candidates: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b) of nodes: a forest over each group of candidates whose trees are what exact links reach."""
    groups = materialize(connected_components(candidates).withColumnRenamed("component", "part"), "groups")
    # only texts of the rows that stand for a class in a group are shuffled
    reps = materialize(groups.join(classes, "node"), "members")
    bits = bloom.filter_bits(classes.count())
    held = materialize(bloom.holding(reps, F.struct("rep", "rep_mark"), bits), "group_filter")
    some = bloom.flag(texts.filter("text is not null"), F.struct("id", "mark"), held, bits, "maybe").filter("maybe")
    some = some.groupBy("id", "mark").agg(F.first("text").alias("text"))  # of repeated rows, one
    same_row = F.col("rep").eqNullSafe(F.col("id")) & (F.col("rep_mark") == F.col("mark"))
    own_text = materialize(reps.join(some, same_row).select("node", "text"), "member_texts")

    def compared(rows: DataFrame, keys: list[str], last: str, star: bool) -> DataFrame:
        """Joined nodes of each group by keys; where rows have `last` (all but one of a star), only those with the others."""
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def forest(group: list[tuple[bool, int, str]]) -> Iterator[pa.RecordBatch]:
            group.sort()
            ids = np.array([node for _, node, _ in group])
            apart = sum(not x for x, _, _ in group)
            root = links_within([shingles(text, width) for _, _, text in group], percent, apart if star or apart < len(group) else None)
            joined = np.flatnonzero(ids != ids[root])
            if len(joined):
                yield pa.RecordBatch.from_arrays([pa.array(ids[joined]), pa.array(ids[root[joined]])], schema=out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = (r for batch in batches for at in range(0, batch.num_rows, TASK_ROWS) for r in batch.slice(at, TASK_ROWS).to_pylist())
            for _, own in groupby(each, lambda r: [r[k] for k in keys]):
                yield from forest([(r[last], r["node"], r["text"]) for r in own])

        return rows.select(*keys, last, "node", "text").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), "a long, b long")

    # first, each node with the smallest one of its keys: a hub goes to as many tasks as it has parts
    sized = candidates.join(classes.select(F.col("node").alias("a"), "n_shingles"), "a")
    hubs = sized.groupBy("b").agg(F.ceil(F.greatest(F.sum("n_shingles") / TASK_SHINGLES, F.count("*") / TASK_ROWS)).alias("parts"))
    hubs = materialize(hubs, "hubs")
    piece, every = F.pmod(F.xxhash64("a"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    spokes = candidates.join(hubs, "b").select(F.col("a").alias("node"), F.col("b").alias("hub"), piece.alias("piece"), F.lit(True).alias("spoke"))
    centres = hubs.select(F.col("b").alias("node"), F.col("b").alias("hub"), every.alias("piece"), F.lit(False).alias("spoke"))
    stars = materialize(compared(spokes.unionByName(centres).join(own_text, "node"), ["hub", "piece"], "spoke", True), "stars")

    # then what is apart in a group; a block is of one tree of the stars, if that is large, or of several small ones
    trees = connected_components(stars).withColumnRenamed("component", "tree")
    own = materialize(reps.select("node", "part", "n_shingles").join(trees, "node", "left").withColumn("tree", F.coalesce("tree", "node")), "trees")
    whole = own.groupBy("part", "tree").agg(F.sum("n_shingles").alias("words"), F.count("*").alias("rows"))
    blocks_for = F.ceil(F.greatest(F.col("words") * 2 / TASK_SHINGLES, F.col("rows") * 2 / TASK_ROWS))
    small = [F.sum(F.when(blocks_for < 2, F.col(c))).alias(c) for c in ("words", "rows")]
    mixed = whole.groupBy("part").agg(F.count("*").alias("trees"), *small)
    apart = materialize(mixed.filter("trees > 1").select("part", F.coalesce(blocks_for, F.lit(1)).alias("shared")), "apart")
    sizes = materialize(whole.withColumn("alone", blocks_for).join(apart, "part").select("part", "tree", "alone", "shared"), "tree_sizes")
    lone = F.col("alone") >= 2
    number = F.pmod(F.xxhash64("node"), F.when(lone, F.col("alone")).otherwise(F.col("shared")))
    block = F.struct(F.when(lone, F.col("tree")).otherwise(-1).alias("tree"), number.alias("number"))
    placed = materialize(own.join(sizes, ["part", "tree"]).select("node", "part", block.alias("block")), "placed")
    blocks_ = materialize(placed.select("part", "block").distinct(), "blocks")
    pairs = blocks_.withColumnRenamed("block", "i").join(blocks_.withColumnRenamed("block", "j"), "part")
    pairs = materialize(pairs.filter("i <= j and (i.tree = -1 or i.tree != j.tree)"), "block_pairs")  # of blocks, not of documents
    first = pairs.select("part", "i", "j", F.col("i").alias("block"), F.lit(False).alias("second"))
    second = pairs.filter("i != j").select("part", "i", "j", F.col("j").alias("block"), F.lit(True).alias("second"))
    tasks = placed.join(first.unionByName(second), ["part", "block"]).select("node", "part", "i", "j", "second")
    rest = compared(tasks.join(own_text, "node"), ["part", "i", "j"], "second", False)
    return materialize(stars.unionByName(rest), "links")
