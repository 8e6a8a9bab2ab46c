from __future__ import annotations

import dataclasses
import json
import os
import shutil
import tempfile
import time

import pandas as pd
import pytest

from premia import artifact
from premia.advisor import LocalAdvisor, check_policy, check_summary, derived_seed
from premia.cli import run_cli
from premia.config import Advisor, Artifact, Config, EarlyStopping, Evaluation, Model, Sampling, config_of, config_toml, load_config
from premia.engine import PricingEngine
from premia.errors import AdvisorError, ArtifactError, ConfigError, JournalError, LegacyArtifactError, ProviderRejected, ProviderUnavailable, RunLocked, SourceError
from premia.journal import Journal, RunLock
from premia.provider import ask, quote, resolve
from premia.run import MappingRun
from premia.schema import FIELD_ORDER, SPLITS
from premia.sources.files import read_quotes, read_seed, strict_json, write_csv


def tiny(folder, **sampling):
    base = {"mapping_budget": 10, "initial_size": 6, "batch_size": 2, "pool_size": 30, "seed": 17} | sampling
    return Config(sampling=Sampling(**base), evaluation=Evaluation(budget=9, bootstrap=20, least_coverage=0.0, most_coverage=1.0), model=Model(1, 20, 20, 2, 10, 1000.0, 5), artifact=Artifact(str(folder / "runs"), str(folder / "artifacts")))


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    config = tiny(folder)
    return config, MappingRun(spark, config, "one").run()


def test_run(spark, finished):
    config, result = finished
    rows = Journal(spark, config.artifact.runs + "/one", {"provider": "premia:tariff"}).samples().toPandas()
    assert rows.split.value_counts().to_dict() == {"mapping": 10, "validation": 3, "calibration": 3, "audit": 3}
    assert rows.row_key.is_unique and rows[rows.split != "mapping"].id.max() < rows[rows.split == "mapping"].id.min()
    assert sorted(p.name for p in result.artifact.iterdir()) == sorted([*artifact.FILES, "manifest.json"])


def test_crash_and_resume(spark, tmp_path, finished, monkeypatch):
    """A run that dies in the middle and is resumed ends as one that doesn't."""
    config = dataclasses.replace(finished[0], artifact=Artifact(str(tmp_path / "runs"), str(tmp_path / "artifacts")))
    calls = []
    whole = MappingRun._judge

    def dies(self, journal):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        whole(self, journal)

    monkeypatch.setattr(MappingRun, "_judge", dies)
    with pytest.raises(KeyboardInterrupt):
        MappingRun(spark, config, "two").run()
    monkeypatch.setattr(MappingRun, "_judge", whole)
    with pytest.raises(JournalError):
        MappingRun(spark, config, "two").run()
    other = dataclasses.replace(config, sampling=dataclasses.replace(config.sampling, seed=18))
    with pytest.raises(JournalError, match="fingerprint"):
        MappingRun(spark, other, "two").run(resume=True)
    found = MappingRun(spark, config, "two").run(resume=True)
    a, b = (pd.read_csv(p / "dataset.csv") for p in (found.artifact, finished[1].artifact))
    pd.testing.assert_frame_equal(a, b)
    assert json.loads((found.artifact / "metadata.json").read_text())["model_version"] == json.loads((finished[1].artifact / "metadata.json").read_text())["model_version"]


def test_engine_and_cli(spark, finished, valid_row, tmp_path, capsys):
    path = finished[1].artifact
    engine = PricingEngine.load(path, spark)
    one = engine.predict_row(valid_row)
    assert 0 <= one["lower"] <= one["premium"] <= one["upper"] and one["warnings"] == ["fewer than 20 calibration rows"]
    source = tmp_path / "in.csv"
    pd.DataFrame([valid_row, valid_row | {"excess": 0}])[list(FIELD_ORDER)].to_csv(source, index=False)
    assert run_cli(["predict", "batch", "--artifact", str(path), "--input", str(source), "--output", str(tmp_path / "out.csv")]) == 0
    out = pd.read_csv(tmp_path / "out.csv")
    assert len(out) == 2 and abs(out.premium[0] - one["premium"]) < 1e-9
    assert run_cli(["predict", "row", "--artifact", str(path), "--input", json.dumps(valid_row)]) == 0
    assert run_cli(["predict", "row", "--artifact", str(path), "--input", json.dumps(valid_row | {"usage": "x"})]) == 2
    assert run_cli(["artifact", "inspect", "--artifact", str(path)]) == 0
    assert run_cli(["artifact", "inspect", "--artifact", str(tmp_path / "none")]) == 4
    assert run_cli(["model", "evaluate", "--artifact", str(path), "--require-gates"]) == 0
    assert run_cli(["nonsense"]) == 2
    (tmp_path / "c.toml").write_text(config_toml(finished[0]))
    assert run_cli(["config", "validate", "--config", str(tmp_path / "c.toml")]) == 0
    assert finished[0].fingerprint() in capsys.readouterr().out


@pytest.mark.parametrize("name", ["model.json", "dataset.csv", "conformal.json", "MODEL_CARD.md"])
@pytest.mark.parametrize("sign", [True, False])
def test_altered_artifact(spark, finished, tmp_path, name, sign):
    path = tmp_path / "copy"
    shutil.copytree(finished[1].artifact, path)
    target = path / name
    if name == "conformal.json":
        target.write_text(json.dumps(json.loads(target.read_text()) | {"rank": 99}))
    elif name == "model.json":
        target.write_text(json.dumps(json.loads(target.read_text()) | {"kind": "other"}))
    elif name == "dataset.csv":
        target.write_text("\n".join(target.read_text().splitlines()[:-1]) + "\n")
    else:
        target.write_text("changed")
    if sign:
        manifest = json.loads((path / "manifest.json").read_text())
        manifest["files"][name] = artifact.file_hash(target)
        (path / "manifest.json").write_text(json.dumps(manifest))
    if sign and name == "MODEL_CARD.md":
        artifact.validate(path, spark)
        return
    with pytest.raises(ArtifactError):
        artifact.validate(path, spark)


def test_missing_files(finished, tmp_path):
    path = tmp_path / "copy"
    shutil.copytree(finished[1].artifact, path)
    (path / "extra").write_text("")
    with pytest.raises(ArtifactError, match="extra"):
        artifact.validate(path)
    (path / "manifest.json").unlink()
    with pytest.raises(LegacyArtifactError):
        artifact.validate(path)


def test_lock_and_tampering(spark, tmp_path, finished):
    with RunLock(tmp_path / "r"), pytest.raises(RunLocked), RunLock(tmp_path / "r"):
        pass
    copy = tmp_path / "one"
    shutil.copytree(finished[0].artifact.runs + "/one", copy)
    journal = Journal(spark, copy, {"provider": "premia:tariff"})
    journal.validate()
    rows = journal.table("samples")
    with pytest.raises(JournalError):
        journal.register(rows)
    journal.append("samples", rows.limit(1).withColumn("excess", (rows.excess + 1) % 5000))
    with pytest.raises(JournalError, match="altered"):
        journal.validate()


def test_failed_quote_leaves_the_rest(spark, tmp_path):
    def flaky(row):
        if row["claims_5y"] >= 4:
            raise ValueError("no")
        return 300.0

    config = tiny(tmp_path, mapping_budget=6)
    with pytest.raises(ProviderRejected):
        MappingRun(spark, config, "bad", flaky).run()
    journal = Journal(spark, tmp_path / "runs/bad", {"provider": resolve(flaky).identity})
    assert 0 < journal.table("quotes").count() < 9 and journal.table("attempts").count() == 9


def test_retries():
    pauses: list[float] = []
    answers = iter([ProviderUnavailable(), ProviderUnavailable(), 5])

    def call(_):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    value, error, attempts = ask(call, {}, 2, 0.05, 0.08, pauses.append)
    assert (value, error, pauses, [a[1] for a in attempts]) == (5.0, None, [0.05, 0.08], ["retryable_failure"] * 2 + ["success"])
    for bad in (True, -1, float("nan"), "5", None):
        assert ask(lambda _, b=bad: b, {}, 2, 0, 0, pauses.append)[1] == "ProviderRejected"
    for bad in ("nonsense", "no.such.module:f", "premia.schema:nothing"):
        with pytest.raises(ConfigError):
            resolve(bad)


@pytest.mark.parametrize("strategy", ["random", "lhs", "bayesian"])
def test_strategies(spark, tmp_path, strategy):
    result = MappingRun(spark, tiny(tmp_path, strategy=strategy, mapping_budget=8), "s").run()
    assert result.report["metrics"]["n"] == 3


class FakeTransport:
    def __init__(self, content):
        self.content = content

    def request(self, method, path, payload, timeout, most):
        found = {"/api/version": {"version": "1"}, "/api/tags": {"models": [{"name": "m", "digest": "a" * 64}]}}
        return json.dumps(found.get(path) or {"message": {"content": self.content}}).encode()


def test_advisor(spark, tmp_path):
    settings = Advisor(model="m", version="1", digest="a" * 64)
    good = json.dumps({"policy": "explore", "bin_boosts": [{"bin_id": "v1:cat:usage:2", "boost": 1.25}]})
    config = dataclasses.replace(tiny(tmp_path), advisor=settings)
    config = dataclasses.replace(config, sampling=dataclasses.replace(config.sampling, strategy="hybrid", mapping_budget=8))
    advisor = LocalAdvisor(settings, FakeTransport(good))
    MappingRun(spark, config, "h", advisor=advisor).run()
    assert [r["policy"] for r in advisor.records] == ["explore"]
    for bad in ("{}", '{"policy": "x", "bin_boosts": []}', good.replace("1.25", "9"), '{"policy": "explore", "policy": "explore", "bin_boosts": []}', good.replace("usage:2", "usage:9")):
        with pytest.raises(AdvisorError):
            check_policy(bad, {"v1:cat:usage:2"})
        with pytest.raises(AdvisorError):
            LocalAdvisor(settings, FakeTransport(bad)).advise({}, {"v1:cat:usage:2"}, 1)
    for bad in ({"premium": 1}, {"a": [{"Driver_Age": 1}]}, {"a": float("nan")}, {"a": "x" * 70000}):
        with pytest.raises(AdvisorError):
            check_summary(bad)
    assert derived_seed(17, 3) == 461971290


def test_config(tmp_path):
    config = tiny(tmp_path)
    (tmp_path / "c.toml").write_text(config_toml(config))
    assert load_config(tmp_path / "c.toml") == config
    assert Evaluation(budget=11, bootstrap=1).split_counts() == {"validation": 5, "calibration": 3, "audit": 3}
    for raw in ({"unknown": 1}, {"sampling": {"seed": True}}, {"sampling": {"initial_size": 300}}, {"evaluation": {"audit_fraction": 0.5}}, {"bounds": {"driver_age": [5, 20]}}, {"sampling": {"strategy": "hybrid"}}, {"artifact": {"runs": "../x"}}, {"advisor": {"endpoint": "http://localhost:1"}}, {"advisor": {"endpoint": "https://127.0.0.1"}}, {"early_stopping": {"patience": -1}}):
        with pytest.raises(ConfigError):
            config_of(raw)
    assert EarlyStopping().patience == 0


def test_csv_sources(spark, tmp_path, valid_row):
    def put(rows, columns, name="x.csv"):
        (tmp_path / name).write_text("\n".join([",".join(columns), *(",".join(map(str, r)) for r in rows)]) + "\n")
        return str(tmp_path / name)

    values = [valid_row[n] for n in FIELD_ORDER]
    assert read_quotes(spark, put([values], FIELD_ORDER)).count() == 1
    assert read_seed(spark, put([[*values, 500]], [*FIELD_ORDER, "premium"])).count() == 1
    for rows, columns in (([values[:-1]], FIELD_ORDER), ([values], FIELD_ORDER[::-1]), ([[*values, 1]], FIELD_ORDER), ([[12.0, *values[1:]]], FIELD_ORDER), ([], FIELD_ORDER)):
        with pytest.raises(SourceError):
            read_quotes(spark, put(rows, columns))
    for rows in ([[*values, -1]], [[*values, "nan"]], [[*values, 5], [*values, 6]]):
        with pytest.raises(SourceError):
            read_seed(spark, put(rows, [*FIELD_ORDER, "premium"]))
    for raw in ('{"a": 1, "a": 2}', '{"a": NaN}', "{"):
        with pytest.raises(SourceError):
            strict_json(raw)
    write_csv(spark.range(3), tmp_path / "three.csv")
    assert len(pd.read_csv(tmp_path / "three.csv")) == 3 and SPLITS[0] == "mapping"


def altered(path, name, keys, value):
    """Sets one value of a file of an artifact (drops it if value is ...) and signs the file again."""
    held = json.loads((path / name).read_text())
    inner = held
    for key in keys[:-1]:
        inner = inner[key]
    if value is ...:
        del inner[keys[-1]]
    else:
        inner[keys[-1]] = value
    (path / name).write_text(json.dumps(held))
    manifest = json.loads((path / "manifest.json").read_text())
    manifest["files"][name] = artifact.file_hash(path / name)
    (path / "manifest.json").write_text(json.dumps(manifest))


@pytest.mark.parametrize(("name", "keys", "value"), [
    ("metadata", ["model_version"], " "), ("metadata", ["artifact_version"], 2), ("metadata", ["warnings"], [1]), ("metadata", ["extra"], 1), ("metadata", ["rows", "audit"], 4),
    ("metadata", ["rows", "audit"], True), ("metadata", ["fingerprint"], "0"), ("metadata", ["revision"], 1), ("metadata", ["spec", "name"], "other"),
    ("conformal", ["n"], 4), ("conformal", ["coverage"], 0.5), ("conformal", ["radius"], -1.0), ("conformal", ["radius"], "1"), ("conformal", ["rank"], ...),
    ("evaluation", ["metrics", "n"], 2), ("evaluation", ["metrics", "mae"], 1e9), ("evaluation", ["metrics", "rmse"], True), ("evaluation", ["slices", "young_driver", "n"], 4),
    ("evaluation", ["slices", "young_driver"], ...), ("evaluation", ["bootstrap", "mae", "lower"], 1e9), ("evaluation", ["interval", "coverage"], 1.5), ("evaluation", ["interval", "n"], 2),
    ("evaluation", ["interval", "p95_width"], 1e9), ("evaluation", ["gates", "coverage"], False), ("evaluation", ["gates", "latency"], False), ("evaluation", ["gates", "coverage"], 1),
    ("evaluation", ["latency_ms"], 1e6), ("evaluation", ["advisor"], {}), ("selection", ["chosen"], "other"), ("selection", ["candidates"], []), ("selection", ["candidates", 0, "mae"], None),
    ("provider", ["attempts"], 0), ("provider", ["identity"], ""), ("provider", ["latency_ms"], -1.0), ("dependencies", ["numpy"], ...), ("dependencies", ["numpy"], ""),
    ("model", ["trees", 0, "left", 0], 0), ("model", ["trees", 0, "feature", 0], 15), ("model", ["trees", 0, "value"], []), ("model", ["trees"], []), ("row-schema", ["type"], "none"),
    ("encoder", ["extra"], 1),
])
def test_audit(finished, tmp_path, name, keys, value):
    """Files that are signed but contradict one another, or aren't of their shape, are no artifact."""
    path = tmp_path / "copy"
    shutil.copytree(finished[1].artifact, path)
    artifact.validate(path)
    altered(path, f"{name}.json", keys, value)
    with pytest.raises(ArtifactError):
        artifact.validate(path)


def test_links_and_manifests(finished, tmp_path):
    path = tmp_path / "copy"
    shutil.copytree(finished[1].artifact, path)
    held = json.loads((path / "manifest.json").read_text())
    (path / "manifest.json").write_text(json.dumps(held | {"more": 1}))
    with pytest.raises(ArtifactError, match="manifest"):
        artifact.validate(path)
    (path / "manifest.json").write_text(json.dumps(held))
    (path / "MODEL_CARD.md").rename(tmp_path / "card")
    (path / "MODEL_CARD.md").symlink_to(tmp_path / "card")
    with pytest.raises(ArtifactError, match="regular"):
        artifact.validate(path)


def test_batch_keeps_order(spark, finished, valid_row, tmp_path):
    """A batch is written in the order of its rows, by several tasks, with each row's own premium."""
    rows = pd.DataFrame([valid_row | {"excess": 10 * i} for i in range(200)])[list(FIELD_ORDER)]
    rows.to_csv(tmp_path / "in.csv", index=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        parts = read_quotes(spark, str(tmp_path / "in.csv")).rdd.getNumPartitions()
        assert run_cli(["--log-level", "INFO", "predict", "batch", "--artifact", str(finished[1].artifact), "--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "out.csv")]) == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    out = pd.read_csv(tmp_path / "out.csv")
    engine = PricingEngine.load(finished[1].artifact)
    assert parts > 1 and out.excess.tolist() == rows.excess.tolist() and sorted(p.name for p in tmp_path.iterdir()) == ["in.csv", "out.csv"]
    assert abs(out.premium - engine.predict_premiums(rows.to_dict("records"))).max() < 1e-9


def test_concurrency(spark, valid_row, tmp_path):
    """Of a thread-safe provider more calls run at once than there are slots, and never more than it declares."""
    folder = str(tmp_path)

    def slow(row):
        own = tempfile.NamedTemporaryFile(dir=folder, delete=False)
        seen = len(os.listdir(folder))
        time.sleep(0.3)
        os.unlink(own.name)
        return float(seen)

    slow.thread_safe, slow.max_concurrency = True, 4 * spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame(pd.DataFrame([{"id": i} | valid_row | {"excess": i} for i in range(200)]))
    found = quote(rows, resolve(slow)).select("premium").toPandas()["premium"]
    assert len(found) == 200 and spark.sparkContext.defaultParallelism < found.max() <= slow.max_concurrency


def test_failed_attempts_are_logged(caplog, valid_row):
    def call(_):
        raise ProviderUnavailable(f"postcode {valid_row['postcode_risk']}")

    ask(call, valid_row, 1, 0, 0, lambda _: None)
    assert [r.getMessage() for r in caplog.records] == [f"attempt {k} of 2: retryable_failure (ProviderUnavailable)" for k in (1, 2)]
