"""Estimators of a premium from the 15 ordinal fields, and the Gaussian process on the 23 scaled ones."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np

from premia.errors import ArtifactError
from premia.models.trees import Tree, bin_edges, grow, random_tree
from premia.schema import FIELD_ORDER

# Direction in which a premium may move with a field.
MONOTONE = {"vehicle_value": 1, "postcode_risk": 1, "theft_risk": 1, "claims_5y": 1, "convictions_5y": 1, "annual_km": 1, "excess": -1}
BOOSTED, EXTRA_TREES, FOREST = "hist_gradient_boosting", "extra_trees", "random_forest"


@dataclass
class Estimator:
    """A sum (boosted) or mean (forests) of trees over a base value; premiums are never negative."""

    kind: str
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        found = np.sum([t.predict(rows) for t in self.trees], axis=0) if self.trees else np.zeros(len(rows))
        return np.maximum(self.base + found if self.kind == BOOSTED else found / max(1, len(self.trees)), 0.0)

    def predict_one(self, row: list[float]) -> float:
        found = sum(t.predict_one(row) for t in self.trees)
        return max(self.base + found if self.kind == BOOSTED else found / max(1, len(self.trees)), 0.0)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> Estimator:
        if raw.get("kind") not in (BOOSTED, EXTRA_TREES, FOREST) or not raw.get("trees"):
            raise ArtifactError("not a fitted estimator of a known kind")
        return cls(raw["kind"], float(raw["base"]), [Tree(**t) for t in raw["trees"]])


def fit(kind: str, parameters: Mapping[str, Any], rows: np.ndarray, targets: np.ndarray, seed: int, monotone: bool = False) -> Estimator:
    """Fits an estimator of that kind; `monotone` holds only for the boosted one."""
    if kind == BOOSTED:
        least = max(1, min(int(parameters["min_samples_leaf"]), len(rows) // 3 or 1))
        signs = np.array([MONOTONE.get(n, 0) if monotone else 0 for n in FIELD_ORDER])
        edges = bin_edges(rows)
        binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        found = Estimator(kind, float(targets.mean()))
        now = np.full(len(rows), found.base)
        for _ in range(int(parameters["max_iter"])):
            tree = grow(binned, edges, now - targets, signs, int(parameters["max_leaf_nodes"]), least, float(parameters["l2_regularization"]), float(parameters["learning_rate"]))
            now += tree.predict(rows)
            found.trees.append(tree)
        return found
    rng = np.random.default_rng(seed)
    found = Estimator(kind)
    for _ in range(int(parameters["n_estimators"])):
        at = rng.integers(0, len(rows), len(rows)) if kind == FOREST else np.arange(len(rows))
        found.trees.append(random_tree(rows[at], targets[at], rng, float(parameters["max_features"]), int(parameters["min_samples_leaf"]), parameters.get("max_depth"), kind == EXTRA_TREES))
    return found


@dataclass
class GaussianProcess:
    """Matern 3/2 with length 1, unit variance and white noise, none of them fitted; targets are standardised.

    The training rows are those of a mapping budget, so that one Cholesky factor is small.
    """

    noise: float = 1e-6
    jitter: float = 1e-8

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0.0)) * np.sqrt(3.0)
        return (1 + gap) * np.exp(-gap)

    def fit(self, rows: np.ndarray, targets: np.ndarray) -> GaussianProcess:
        self.rows, self.mean, self.scale = rows, float(targets.mean()), float(targets.std()) or 1.0
        k = self._kernel(rows, rows)
        k[np.diag_indices_from(k)] = 1.0 + self.noise + self.jitter
        self.inverse = np.linalg.inv(np.linalg.cholesky(k))
        self.weights = self.inverse.T @ (self.inverse @ ((targets - self.mean) / self.scale))
        return self

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean, standard deviation), the noise included; variances that rounding makes negative are 0."""
        k = self._kernel(rows, self.rows)
        variance = np.maximum(1.0 + self.noise - ((self.inverse @ k.T) ** 2).sum(0), 0.0)
        return self.mean + self.scale * (k @ self.weights), self.scale * np.sqrt(variance)
