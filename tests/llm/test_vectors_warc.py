from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
from helpers import rows_of

from premia.llm.components import connected_components
from premia.llm.vectors import near_vectors
from premia.llm.warc import F, read_archives, resolve, rewrite_archives, write_archives

VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = []
    for c in range(6):
        center = rng.normal(size=16)
        for k in range(30):
            rows.append((c * 100 + k, (center + rng.normal(size=16) * 0.05 * (k % 4)).tolist(), c % 2))
    rows += [(700 + k, rows[0][1], 0) for k in range(9)] + [(720, rows[0][1], 1), (721, rows[0][1], None)]
    rows += [(730, None, 1), (731, [0.0] * 16, 1), (732, [float("nan")] * 16, 1), (733, [1.0, None], 1), (734, [float("inf")] * 16, 0), (735, [], 0), (736, [1.0, 2.0], 0), (737, [2.0, 4.0], 0), (738, [-0.0, 1.0], 0), (739, [0.0, 1.0], 0), (739, [0.0, 1.0], 0), (None, [5.0, -1.0], 1)]
    return rows


def brute(rows):
    n = len(rows)
    fine = [r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if f else None for r, f in zip(rows, fine, strict=True)]
    links, root = [0] * n, list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(n):
            if i != j and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return sorted(((r[0], links[i], least.get(top(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("home", [4096, 7])
def test_vectors(spark, home, monkeypatch):
    monkeypatch.setattr("premia.llm.vectors.HOME_ROWS", home)
    monkeypatch.setattr("premia.llm.vectors.BLOCK_ROWS", 16)
    frame = spark.createDataFrame(odd_vectors(), VECTORS).repartition(3)
    found = near_vectors(frame.withColumns({c: F.lit(1) for c in ("id", "v", "key", "rep", "cell", "n_links", "weight")}))
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found.collect()), key=str) == brute(odd_vectors())
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5)]
    root = list(range(500))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    want = {i: top(i) for p in pairs for i in p if p[0] != p[1]}
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("least", [0, 6])
def test_warc(spark, least):
    rows = [(i, f"http://x/{i}", f"<p>{'é' * (i % 5)}{i % 7}</p>") for i in range(60)] + [(100, None, None), (101, "http://y y", ""), (102, "u", "same"), (102, "u", "same"), (103, "u\r\nX: 1", "a\r\n\r\nb"), (None, "n", "<p>0</p>"), (None, None, "nobody else"), (104, "long", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("uri", "digest", "archive", "at", "response")}).repartition(4)
    found = read_archives(rewrite_archives(resolve(write_archives(pages), least))).collect()
    most: dict[str, int | None] = {}
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    digests = [base64.b32encode(hashlib.sha1(b).digest()).decode() for _, b in payloads]
    for (p, b), d in zip(payloads, digests, strict=True):
        if len(b) >= least:
            most[d] = max((x for x in (p, most.get(d)) if x is not None), default=None)
    want = []
    for (p, b), d in zip(payloads, digests, strict=True):
        again = len(b) >= least and p != most[d]
        want.append((p, len(b), d, "revisit" if again else "response", most[d] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == sorted(want, key=str)


def test_warc_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert rows_of(read_archives(rewrite_archives(resolve(write_archives(pages))))) == []


@pytest.mark.parametrize("scale", [1e200, 1e-200, 5e-324])
def test_vectors_of_any_length(spark, scale):
    """Squares of components may overflow or vanish."""
    rows = [(1, [scale, scale], 0), (2, [2.0, 2.0], 0), (3, [1.0, -1.0], 0), (4, [3 * scale, 0.0], 0), (5, [0.5, 0.0], 0)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4)]


@pytest.mark.parametrize(("home", "repeated"), [(4096, False), (40, True)])
def test_vectors_of_many_cells(spark, home, repeated, monkeypatch):
    """Each label has cells of its own, several blocks a cell, ids that repeat under different labels."""
    monkeypatch.setattr("premia.llm.vectors.ONE_CELL", 50)
    monkeypatch.setattr("premia.llm.vectors.HOME_ROWS", home)
    monkeypatch.setattr("premia.llm.vectors.BLOCK_ROWS", 32)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 12))
    rows = [(i, (base[i % 300] + rng.normal(size=12) * 0.12 * (i >= 300)).tolist(), int(i % 2)) for i in range(900)]
    rows = [(i, rows[i][1], rows[i][2]) for i in range(900)] + ([(0, rows[1][1], 0)] if repeated else [])
    found = near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str)
    want = brute(rows)
    assert sum(x[1] > 0 for x in want) > 400
    assert got == want
