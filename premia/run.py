"""A mapping run: holdouts first, then batches that are proposed, quoted and judged, then a model and its artifact."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import secrets
import shutil
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia import artifact as artifacts
from premia.advisor import LocalAdvisor, PolicyAdvisor, advisor_report, check_decision, derived_seed
from premia.config import Config
from premia.errors import ProviderRejected
from premia.journal import BATCHES, DECISIONS, Journal, RunLock
from premia.models import search
from premia.models.estimators import EXTRA_TREES, fit
from premia.operators import acquire, encode, evaluate, sample
from premia.operators import journal as steps
from premia.provider import Quote, quote, resolve
from premia.schema import FIELD_ORDER

HOLDOUTS = ("validation", "calibration", "audit")
#: How often rows are drawn, each time twice as many, before a domain counts as used up.
ATTEMPTS = 6


def default_run_id() -> str:
    return f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{secrets.token_hex(4)}"


@dataclass(frozen=True)
class Result:
    run_id: str
    artifact: Path
    report: dict[str, Any]


class MappingRun:
    """One run. Every step reads the journal, does a bounded Spark job and appends; resuming goes on where it ended."""

    def __init__(self, spark: SparkSession, config: Config, run_id: str | None = None, provider: str | Quote | None = None, advisor: PolicyAdvisor | None = None) -> None:
        self.spark, self.config, self.run_id = spark, config, run_id or default_run_id()
        self.provider = resolve(provider if provider is not None else config.provider.callable)
        self.domain, self.advisor, self.runtime = config.domain(), None, None
        if config.sampling.strategy == "hybrid":
            self.advisor = advisor if advisor is not None else LocalAdvisor(config.advisor)
        self.folder = Path(config.artifact.runs) / self.run_id
        self.seed = config.sampling.seed

    def _metadata(self) -> dict[str, Any]:
        """What a run is begun with and resumed with; of a hybrid one, also the advisor that answers."""
        named = {"version": 1, "fingerprint": self.config.fingerprint(), "provider": self.provider.identity, "domain": self.domain.to_dict()}
        if self.advisor is not None:
            self.runtime = self.advisor.verify()
            named["advisor"] = self.runtime
        return named

    def run(self, resume: bool = False, seed_rows: DataFrame | None = None) -> Result:
        named = self._metadata()
        with RunLock(self.folder):
            journal = (Journal.open if resume else Journal.create)(self.spark, self.folder, named)
            if journal.table("samples").head() is None:
                self._holdouts(journal)
            journal.validate()
            self._quote(journal)
            if seed_rows is not None and not journal.table("samples").filter("split = 'mapping'").head():
                self._seed(journal, seed_rows)
            self._map(journal)
            return self._finish(journal)

    def _register(self, journal: Journal, rows: DataFrame, split: F.Column | str, batch: int | None, source: str) -> None:
        first = steps.next_id(journal.table("samples"), "id").first().next_id
        split = F.lit(split) if isinstance(split, str) else split
        journal.register(rows.select((F.col("position") + first).alias("id"), split.alias("split"), F.lit(batch).cast("long").alias("batch_id"), "position", encode.row_key().alias("row_key"), F.lit(source).alias("source"), *FIELD_ORDER))

    def _fresh(self, journal: Journal, n: int, stream: int, batch: int, lhs: bool, more_used: DataFrame | None = None) -> DataFrame:
        """position and fields of n new rows; twice as many are made, and more up to ATTEMPTS times if the domain is tiny."""
        make = sample.lhs_rows if lhs else sample.uniform_rows
        used = journal.table("samples").select("row_key")
        used = used if more_used is None else used.unionByName(more_used.select("row_key"))
        for attempt in range(ATTEMPTS):
            made = make(self.spark, (2 * n + 10) << attempt, self.seed, stream, batch, self.domain)
            rows = sample.unique_rows(made, used, n).toPandas()
            if len(rows) == n:
                break
        else:
            raise ValueError(f"fewer than {n} new rows in {(2 * n + 10) << (ATTEMPTS - 1)} draws")
        rows["position"] = range(n)
        return self.spark.createDataFrame(rows[["position", *FIELD_ORDER]])

    def _holdouts(self, journal: Journal) -> None:
        counts = self.config.evaluation.split_counts()
        rows, split, upto = self._fresh(journal, self.config.evaluation.budget, sample.EVALUATION, 0, False), F.lit(HOLDOUTS[-1]), 0
        bounds = []
        for name in HOLDOUTS:
            upto += counts[name]
            bounds.append((name, upto))
        for name, end in reversed(bounds[:-1]):
            split = F.when(F.col("position") < end, name).otherwise(split)
        self._register(journal, rows, split, None, "holdout")

    def _most(self) -> int:
        """Rows that any split of the run may have."""
        return max(self.config.sampling.mapping_budget, self.config.evaluation.budget, 1)

    def _seed(self, journal: Journal, rows: DataFrame) -> None:
        held = rows.toPandas()
        held["position"] = range(len(held))
        frame = self.spark.createDataFrame(held)
        self._register(journal, frame, "mapping", 0, "seed")
        journal.append("quotes", frame.select(F.lit(self.provider.identity).alias("provider_identity"), encode.row_key().alias("row_key"), "premium"))

    def _quote(self, journal: Journal) -> None:
        """Asks for what is pending. Answers are written before any error of theirs is raised."""
        pending = journal.samples().filter("status = 'pending'")
        if pending.head() is None:
            return
        limits = self.config.provider
        answers = self.folder / f"answers-{secrets.token_hex(4)}"
        asked = quote(pending.select("id", *FIELD_ORDER), self.provider, limits.retries, limits.first_pause, limits.most_pause)
        asked.write.parquet(answers.resolve().as_uri())  # once; what follows reads the answers, and no lost executor asks again
        try:
            found = self.spark.read.schema(asked.schema).parquet(answers.resolve().as_uri())
            journal.append("attempts", found.select("row_key", F.explode("attempts").alias("a")).select("row_key", "a.*"))
            good = found.filter("premium IS NOT NULL")
            journal.append("quotes", good.select(F.lit(self.provider.identity).alias("provider_identity"), "row_key", "premium"))
            if failed := found.filter("error IS NOT NULL").orderBy("id").select("row_key", "error").head():
                raise ProviderRejected(f"row {failed.row_key[:12]}: {failed.error}")
        finally:
            shutil.rmtree(answers, ignore_errors=True)

    def _map(self, journal: Journal) -> None:
        sampling = self.config.sampling
        while True:
            self._judge(journal)
            done = journal.table("samples").filter("split = 'mapping'").count()
            if done >= sampling.mapping_budget or self._stopped(journal):
                return
            batch = steps.next_id(journal.table("samples"), "batch_id").first().next_id
            count = min(sampling.initial_size if done == 0 else sampling.batch_size, sampling.mapping_budget - done)
            rows, policy = self._propose(journal, count, batch, first=done == 0)
            self._register(journal, rows, "mapping", batch, policy or ("initial" if done == 0 else sampling.strategy))
            self._quote(journal)

    def _propose(self, journal: Journal, count: int, batch: int, first: bool) -> tuple[DataFrame, str | None]:
        strategy = self.config.sampling.strategy
        if first or strategy in ("random", "lhs"):
            return self._fresh(journal, count, sample.MAPPING, batch, strategy != "random"), None
        pool = sample.lhs_rows(self.spark, self.config.sampling.pool_size, self.seed, sample.MAPPING + 1, batch, self.domain)
        pool = sample.unique_rows(pool, journal.table("samples"), self.config.sampling.pool_size).withColumnRenamed("i", "quote_id").select("quote_id", *FIELD_ORDER)
        pool = self.spark.createDataFrame(pool.toPandas())  # a pool has the size that the configuration names
        done, held = journal.samples().filter("split = 'mapping'"), journal.samples().filter("split = 'validation'")
        x, y = search.matrices(done, self._most())
        if strategy == "active":
            members = search.committee(self.spark, (x, y), self.seed, self.config.model.committee, self.config.model.committee_trees)
            spread, anchors = search.spread(pool, members), search.spread(held, members, "id")
        else:
            spread, anchors = (search.gp_spread(rows, done, key, self._most()) for rows, key in ((pool, "quote_id"), (held, "id")))
        residual = held.join(anchors.select("id", "mean"), "id").withColumn("residual", F.abs(F.col("premium") - F.col("mean"))).withColumnRenamed("id", "quote_id")
        wide = acquire.with_vector(pool)
        bounds = self._most()
        near = acquire.nearest(wide, acquire.with_vector(residual), "quote_id", "residual", most=bounds).select("quote_id", "residual")
        scores = pool.join(spread.select("quote_id", "uncertainty"), "quote_id").join(near, "quote_id")
        policy = None
        if strategy == "active":
            a = self.config.sampling.acquisition
            far = acquire.nearest(wide, acquire.with_vector(done), "id", most=bounds).select("quote_id", F.col("distance").alias("diversity"))
            weights = {k: getattr(a, k) for k in ("uncertainty", "residual", "breakpoint", "diversity")}
            scored = acquire.combined(scores.join(far, "quote_id").withColumn("breakpoint", acquire.breakpoint_score()), weights)
            focused, spread_weight = acquire.focused_count(count, a.focused_fraction), a.greedy_spread
        else:
            policy, boosts = ("balanced", {}) if self.advisor is None else self._advice(journal, scores, residual, batch)
            acquire.check_boosts(boosts, set(encode.bin_catalogue(self.domain)))
            scored = acquire.policy_scores(scores, policy, boosts).select("quote_id", "score")
            focused, spread_weight = count - acquire.exploration_count(count, policy), self.config.sampling.acquisition.greedy_spread
        chosen = acquire.greedy_batch(scored.join(wide, "quote_id").select("quote_id", "score", *search.VECTOR), focused, spread_weight)
        rows = chosen.join(pool, "quote_id").select(F.col("rank").alias("position"), *FIELD_ORDER)
        rows = self.spark.createDataFrame(rows.toPandas().sort_values("position"))
        if focused < count:
            rest = self._fresh(journal, count - focused, sample.MAPPING, batch, True, rows.select(encode.row_key().alias("row_key")))
            rows = rows.unionByName(rest.withColumn("position", F.col("position") + focused))
        return rows, policy

    def _advice(self, journal: Journal, scores: DataFrame, residual: DataFrame, batch: int) -> tuple[str, dict[str, float]]:
        """The decision of this batch: the stored one if a run that died had made it, or else one that is stored first."""
        names = set(encode.bin_catalogue(self.domain))
        held = journal.table("decisions").filter(F.col("batch_id") == batch).first()
        if held is not None:
            return held.policy, dict(held.boosts)
        bins = self.spark.createDataFrame([(b,) for b in sorted(names)], "bin_id string")
        table = acquire.diagnostic_bins(evaluate.normalized(scores, "uncertainty"), evaluate.normalized(residual, "residual"), bins)
        history = journal.batches().filter("mae IS NOT NULL").select(F.col("batch_id").alias("idx"), "mae", "policy")
        summary = {"bins": [r.asDict() for r in table.orderBy("bin_id").collect()], "validation_mae_trend": [r.mae for r in steps.mae_trend(history).orderBy("idx").collect()], "uncertainty": evaluate.distribution(scores, "uncertainty").first().asDict()}
        seed = derived_seed(self.seed, batch)
        answer = self.advisor.advise(summary, names, seed)
        row = check_decision(self.advisor.records[-1], answer, names, seed, self.runtime) | {"batch_id": batch}
        journal.append("decisions", self.spark.createDataFrame([tuple(row[n] for n in DECISIONS.names)], DECISIONS))
        return answer

    def _judge(self, journal: Journal) -> None:
        """MAE, with bootstrap bounds, of a fixed model on all rows up to each batch that isn't judged yet."""
        rows = journal.samples()
        ready = {r.batch_id for r in rows.filter("split = 'mapping'").groupBy("batch_id").agg(F.count_if(F.col("status") == "pending").alias("p")).filter("p = 0").collect()}
        todo = sorted(ready - {r.batch_id for r in journal.batches().filter("state = 'evaluated'").collect()})
        if not todo:
            return
        held = rows.filter("split = 'mapping'").select("id", "batch_id", "source", "premium", *encode.ordinal(self.domain)).toPandas().sort_values("id")
        least = min(self.config.sampling.initial_size, self.config.sampling.mapping_budget)
        if deferred := [b for b in todo if (held["batch_id"] <= b).sum() < least]:
            # too few rows so far for a model: the batch is done without a MAE, and no step of early stopping sees it
            blank = [(int(b), 1, "evaluated", None, None, None, None) for b in deferred]
            journal.append("batches", self.spark.createDataFrame(blank, BATCHES))
            todo = [b for b in todo if b not in deferred]
        if not todo:
            return
        vx, vy = search.matrices(rows.filter("split = 'validation'").orderBy("id"), self._most())
        seed, stop, boot = self.seed, self.config.early_stopping, self.config.evaluation.bootstrap

        def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
            own = held[held["batch_id"] <= key[0]]
            parameters = {"n_estimators": max(20, min(80, len(own))), "min_samples_leaf": min(2, len(own)), "max_features": 0.8, "max_depth": 18}
            model = fit(EXTRA_TREES, parameters, own[list(FIELD_ORDER)].to_numpy(float), own["premium"].to_numpy(), seed + int(key[0]))
            e = np.abs(model.predict(vx) - vy)
            draws = np.random.default_rng([seed, 100_003 * (int(key[0]) + 1)]).integers(0, len(e), (max(boot, 1), len(e)))
            tail = (1 - stop.confidence) / 2
            low, high = np.quantile(e[draws].mean(1), [tail, 1 - tail]) if boot else (e.mean(), e.mean())
            source = own[own["batch_id"] == key[0]]["source"].iloc[0]
            policy = source if source in acquire.POLICIES else None
            return pd.DataFrame({"batch_id": [int(key[0])], "version": [1], "state": ["evaluated"], "mae": [e.mean()], "lower": [low], "upper": [high], "policy": [policy]})

        journal.append("batches", self.spark.createDataFrame([(int(b),) for b in todo], "batch_id long").groupBy("batch_id").applyInPandas(run, BATCHES))

    def _stopped(self, journal: Journal) -> bool:
        stop = self.config.early_stopping
        found = evaluate.early_stop(journal.batches().filter("mae IS NOT NULL").select(F.col("batch_id").alias("idx"), "mae", "lower", "upper"), stop.patience, stop.least_batches, stop.least_gain).first()
        return bool(found and found.should_stop)

    def _finish(self, journal: Journal) -> Result:
        """Chooses, refits, calibrates and audits a model; validation rows guide, calibration rows set the radius, audit rows report."""
        settings, judged = self.config.model, self.config.evaluation
        rows = journal.samples()
        train, held = (search.matrices(rows.filter(F.col("split") == s).orderBy("id"), self._most()) for s in ("mapping", "validation"))
        specs = search.candidates(settings.search_iterations, self.seed, settings.boosting, settings.extra_trees)
        found = search.search(self.spark, specs, train, held, settings.latency_repetitions).drop("model").collect()
        best = search.choose(found, settings.latency_ceiling_ms)
        spec = next(s for s in specs if s.name == best["name"])
        model = search.refit(spec, np.concatenate([train[0], held[0]]), np.concatenate([train[1], held[1]]), self.seed)
        scored = rows.filter(F.col("split").isin("calibration", "audit")).join(search.score(rows.filter(F.col("split").isin("calibration", "audit")), model, "id"), "id")
        radius = evaluate.conformal_radius(scored.filter("split = 'calibration'"), judged.conformal_coverage).first()
        audit = evaluate.conformal_bounds(scored.filter("split = 'audit'"), F.lit(float(radius.radius))).persist()
        interval = evaluate.interval_report(audit).first().asDict()
        errors = audit.select("id", F.abs(F.col("premium") - F.col("predicted")).alias("e")).toPandas().sort_values("id")
        positions = self.spark.createDataFrame([(i, float(e)) for i, e in enumerate(errors["e"])], "position long, e double")
        report = {
            "latency_ms": best["latency_ms"],
            "metrics": evaluate.point_metrics(audit).first().asDict(),
            "slices": {r["slice"]: {k: v for k, v in r.asDict().items() if k != "slice"} for r in evaluate.slice_report(audit).collect()},
            "bootstrap": {r.metric: {"lower": r.lower, "upper": r.upper} for r in evaluate.bootstrap(positions, len(errors), max(1, judged.bootstrap), judged.confidence, self.seed + 4003).collect()},
            "interval": interval,
            "gates": {"coverage": judged.least_coverage <= interval["coverage"] <= judged.most_coverage, "latency": best["latency_ms"] <= settings.latency_ceiling_ms},
        }
        audit.unpersist()
        if self.advisor is not None:
            decisions = [r.asDict() for r in journal.table("decisions").orderBy("batch_id").collect()]  # one a batch
            report["advisor"] = advisor_report(decisions, self.config.advisor.most_bytes)
            report["gates"]["advisor"] = report["advisor"]["latency_passed"] and report["advisor"]["memory_passed"]
        selection = {"chosen": best["name"], "candidates": [{k: v for k, v in r.asDict().items() if k != "latency_ms"} for r in sorted(found, key=lambda r: r["name"])]}
        conformal = {"coverage": judged.conformal_coverage, "n": radius.n, "rank": radius.conformal_rank, "radius": radius.radius}
        named = {"config": self.config.fingerprint(), "selection": selection, "conformal": conformal, "keys": rows.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", "row_key", F.col("premium").cast("string"))))), 256).alias("d")).first().d}
        version = hashlib.sha256(json.dumps(named, sort_keys=True).encode()).hexdigest()[:16]
        warnings = ["fewer than 20 calibration rows"] if radius.n < 20 else []
        path = artifacts.export(Path(self.config.artifact.artifacts) / self.run_id, dataset=rows.filter("status = 'complete'"), model=model, spec=dataclasses.asdict(spec), domain=self.domain, config=self.config, version=version, conformal=conformal, report=report, selection=selection, provider=steps.provider_summary(journal.table("attempts")).first().asDict() | {"identity": self.provider.identity}, warnings=warnings)
        return Result(self.run_id, path, report)
