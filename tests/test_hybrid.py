"""Stored decisions, what an advisor must be, the hybrid benchmark, ranges of the configuration."""

from __future__ import annotations

import dataclasses
import json

import pytest

from premia.advisor import LocalAdvisor, advisor_report, check_decision
from premia.benchmark import hybrid_gates, run_hybrid_benchmark
from premia.config import Advisor, Artifact, Config, Evaluation, Model, Sampling, config_of
from premia.errors import AdvisorError, ConfigError, JournalError
from premia.journal import Journal
from premia.run import MappingRun

BIN = "v1:cat:usage:2"
SETTINGS = Advisor(model="m", version="1", digest="a" * 64, quantization="Q4_K_M", most_bytes=1000)


class Server:
    """A model server whose answers can be spoiled; counts the policies it gave."""

    def __init__(self, **spoiled):
        self.asked, model = 0, {"name": "m", "digest": "a" * 64}
        self.answers = {"/api/version": {"version": "1"}, "/api/tags": {"models": [model | {"details": {"quantization_level": "Q4_K_M"}}]}, "/api/ps": {"models": [model | {"size": 900}]}}
        self.answers |= {f"/api/{k}": v for k, v in spoiled.items()}

    def request(self, method, path, payload, timeout, most):
        if path == "/api/chat":
            self.asked += 1
            return json.dumps({"message": {"content": json.dumps({"policy": "explore", "bin_boosts": [{"bin_id": BIN, "boost": 1.25}]})}}).encode()
        return json.dumps(self.answers[path]).encode()


def hybrid(folder, **sampling):
    base = {"mapping_budget": 8, "initial_size": 6, "batch_size": 2, "pool_size": 30, "seed": 17, "strategy": "hybrid"} | sampling
    held = Evaluation(budget=9, bootstrap=20, least_coverage=0.0, most_coverage=1.0)
    return Config(sampling=Sampling(**base), evaluation=held, model=Model(1, 20, 20, 2, 10, 1000.0, 5), artifact=Artifact(str(folder / "runs"), str(folder / "artifacts")), advisor=SETTINGS)


def test_a_resumed_run_keeps_its_decision(spark, tmp_path, monkeypatch):
    """A run that dies after a decision is stored doesn't ask again, and goes on with the advisor it began with only."""
    server, config = Server(), hybrid(tmp_path)
    whole = MappingRun._register

    def dies(self, journal, rows, split, batch, source):
        if batch == 1:
            raise KeyboardInterrupt
        whole(self, journal, rows, split, batch, source)

    monkeypatch.setattr(MappingRun, "_register", dies)
    with pytest.raises(KeyboardInterrupt):
        MappingRun(spark, config, "h", advisor=LocalAdvisor(SETTINGS, server)).run()
    monkeypatch.setattr(MappingRun, "_register", whole)
    assert server.asked == 1
    other = dataclasses.replace(SETTINGS, version="2")
    with pytest.raises(JournalError):
        MappingRun(spark, config, "h", advisor=LocalAdvisor(other, Server(version={"version": "2"}))).run(resume=True)
    found = MappingRun(spark, config, "h", advisor=LocalAdvisor(SETTINGS, server)).run(resume=True)
    assert server.asked == 1
    stored = Journal(spark, tmp_path / "runs" / "h", {}).table("decisions").collect()
    assert [(r.batch_id, r.policy, r.boosts, r.resident_bytes) for r in stored] == [(1, "explore", {BIN: 1.25}, 900)]
    assert json.loads(stored[0].runtime)["quantization"] == "Q4_K_M" and len(stored[0].request_digest) == 64
    assert found.report["advisor"]["decisions"] == 1 and found.report["gates"]["advisor"]


@pytest.mark.parametrize("spoiled", [
    {"version": {"version": "2"}}, {"tags": {"models": []}}, {"tags": {"models": "m"}}, {"tags": {"models": [{"name": "m", "digest": "b" * 64}]}},
    {"tags": {"models": [{"name": "m", "digest": "a" * 64, "details": {"quantization_level": "F16"}}]}}, {"tags": {"models": [{"name": "m", "digest": "a" * 64}]}},
    {"ps": {"models": []}}, {"ps": {"models": [{"name": "m", "digest": "a" * 64, "size": 1001}]}}, {"ps": {"models": [{"name": "m", "digest": "a" * 64, "size": True}]}}, {"ps": {"models": [{"name": "m", "digest": "a" * 64, "size": 9}] * 2}},
])
def test_another_advisor_is_not_used(spoiled):
    with pytest.raises(AdvisorError):
        LocalAdvisor(SETTINGS, Server(**spoiled)).advise({}, {BIN}, 1)


def test_decision_of_another_origin():
    advisor = LocalAdvisor(SETTINGS, Server())
    answer, runtime = advisor.advise({}, {BIN}, 5), advisor.verify()
    record = advisor.records[-1]
    assert check_decision(record, answer, {BIN}, 5, runtime)["policy"] == "explore"
    for change in ({"seed": 6}, {"policy": "balanced"}, {"boosts": {}}, {"runtime": {}}, {"attempt_latencies": []}, {"attempt_latencies": [float("inf")]}, {"resident_bytes": -1}):
        with pytest.raises(AdvisorError):
            check_decision(record | change, answer, {BIN}, 5, runtime)
    with pytest.raises(AdvisorError):
        check_decision(record, answer, {"v1:cat:usage:1"}, 5, runtime)


def test_advisor_report():
    rows = [{"attempt_latencies": [5.0, 70_000.0], "resident_bytes": 10, "policy": "explore"}, {"attempt_latencies": [1.0], "resident_bytes": 20, "policy": "balanced"}]
    found = advisor_report(rows, 15)
    assert (found["decisions"], found["attempts"], found["maximum_latency_ms"], found["maximum_resident_bytes"]) == (2, 3, 70_000.0, 20)
    assert not found["latency_passed"] and not found["memory_passed"] and advisor_report([], 15)["latency_passed"]


def records(active, bayesian, hybrid, **spoiled):
    rows = [{"strategy": s, "seed": i, "mae": m, "eligible": True, "advisor_latency": True, "advisor_memory": True, "samples": n} for s, ms, n in (("active", active, 260), ("bayesian", bayesian, 208), ("hybrid", hybrid, 208)) for i, m in enumerate(ms)]
    rows[-1] |= spoiled
    return rows


@pytest.mark.parametrize(("rows", "failed"), [
    (records([100.0] * 5, [100.0] * 5, [90.0] * 5), set()),
    (records([80.0] * 5, [100.0] * 5, [90.0] * 5), {"efficiency"}),
    (records([100.0] * 5, [100.0] * 5, [96.0] * 5), {"ablation"}),
    (records([100.0] * 5, [100.0] * 5, [90.0] * 4 + [111.0]), {"seeds"}),
    (records([100.0] * 5, [100.0] * 5, [90.0] * 5, samples=209), {"budget", "efficiency"}),
    (records([100.0] * 5, [100.0] * 5, [90.0] * 5, eligible=False), {"eligible"}),
    (records([100.0] * 5, [100.0] * 5, [90.0] * 5, advisor_latency=False), {"latency"}),
    (records([100.0] * 5, [100.0] * 5, [90.0] * 5, advisor_memory=False), {"memory"}),
    (records([0.0] * 5, [0.0] * 5, [0.0] * 5), {"ablation"}),
])
def test_hybrid_gates(rows, failed):
    found = hybrid_gates(rows)
    assert {k for k, v in found.items() if v is False and k != "passed"} == failed
    assert found["passed"] is (not failed) and found["strategy"] == ("bayesian" if failed else "hybrid")


def test_hybrid_benchmark(spark, tmp_path):
    found = run_hybrid_benchmark(spark, hybrid(tmp_path), tmp_path / "out", (3,), advisor=LocalAdvisor(SETTINGS, Server()), budgets=(10, 8))
    assert [(r["strategy"], r["samples"]) for r in found["records"]] == [("active", 10), ("bayesian", 8), ("hybrid", 8)]
    assert found["gates"]["memory"] and json.loads((tmp_path / "out" / "summary.json").read_text())["gates"] == found["gates"]
    assert len((tmp_path / "out" / "records.csv").read_text().splitlines()) == 4
    for spoiled in (dataclasses.replace(hybrid(tmp_path, strategy="active"), advisor=None), hybrid(tmp_path, initial_size=7)):
        with pytest.raises(ConfigError):
            run_hybrid_benchmark(spark, spoiled, tmp_path / "out", (3,), budgets=(10, 6))


@pytest.mark.parametrize("raw", [
    {"sampling": {"seed": 2**32}}, {"sampling": {"pool_size": 9}}, {"evaluation": {"conformal_coverage": 0.5}}, {"evaluation": {"confidence": 0.5}}, {"evaluation": {"bootstrap": 100_001}},
    {"early_stopping": {"confidence": 0.5}}, {"model": {"search_iterations": 51}}, {"model": {"boosting": 19}}, {"model": {"extra_trees": 5_001}}, {"model": {"committee": 1}}, {"model": {"committee_trees": 9}},
    {"model": {"latency_repetitions": 4}}, {"model": {"latency_ceiling_ms": float("inf")}}, {"provider": {"retries": 21}}, {"provider": {"most_pause": 601.0}}, {"provider": {"callable": ":f"}}, {"advisor": {"most_bytes": -1}},
])
def test_ranges(raw):
    with pytest.raises(ConfigError):
        config_of(raw)
