"""The policy advisor: a local model is shown aggregates and may name a policy and a few bins, nothing else."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Mapping
from typing import Any, Protocol

from premia.config import Advisor
from premia.errors import AdvisorError, SourceError
from premia.operators.acquire import BOOSTS, MOST_BOOSTS, POLICIES
from premia.schema import FIELD_ORDER
from premia.sources.files import strict_json

# Bytes that an answer, a policy and a summary may have; calls for one answer.
ANSWER_BYTES, POLICY_BYTES, SUMMARY_BYTES, CALLS = 16_384, 4_096, 64_000, 3
# Milliseconds that an answer, and bytes that the model in memory may take to pass a run's gate.
LATENCY_MS, MEMORY_BYTES = 60_000.0, 8 * 1024**3
FORBIDDEN = frozenset({"premium", "row", "rows", "row_key", "quote", "target", *FIELD_ORDER})


class Transport(Protocol):
    def request(self, method: str, path: str, payload: bytes | None, timeout: float, most: int) -> bytes: ...


class PolicyAdvisor(Protocol):
    """Names a policy and boosts by bin; its last record says how it came to them, verify() what it is."""

    records: list[dict[str, Any]]

    def verify(self) -> dict[str, Any]: ...

    def advise(self, summary: Mapping[str, Any], bins: set[str], seed: int) -> tuple[str, dict[str, float]]: ...


def derived_seed(run_seed: int, batch: int) -> int:
    raw = hashlib.sha256(f"{run_seed}:{batch}:policy-advisor-v1".encode()).digest()
    return int.from_bytes(raw[:4], "big") & 0x7FFFFFFF


def check_summary(value: Any) -> None:
    """Raises if the summary holds what could be a row, a number that isn't finite, or too much."""

    def walk(x: Any) -> None:
        if isinstance(x, Mapping):
            for k, v in x.items():
                if str(k).casefold() in FORBIDDEN:
                    raise AdvisorError(f"{k!r} must not leave")
                walk(v)
        elif isinstance(x, list | tuple):
            for v in x:
                walk(v)
        elif isinstance(x, float) and (x != x or abs(x) == float("inf")):
            raise AdvisorError("a number isn't finite")

    walk(value)
    if len(json.dumps(value).encode()) > SUMMARY_BYTES:
        raise AdvisorError("the summary is too large")


def policy_schema() -> dict[str, Any]:
    boost = {"type": "object", "additionalProperties": False, "required": ["bin_id", "boost"], "properties": {"bin_id": {"type": "string"}, "boost": {"enum": list(BOOSTS)}}}
    return {"type": "object", "additionalProperties": False, "required": ["policy", "bin_boosts"], "properties": {"policy": {"enum": list(POLICIES)}, "bin_boosts": {"type": "array", "maxItems": MOST_BOOSTS, "items": boost}}}


def check_policy(raw: bytes | str, bins: set[str]) -> tuple[str, dict[str, float]]:
    """(policy, boost by bin) of an answer that has exactly this form; anything else raises."""
    if len(raw if isinstance(raw, bytes) else raw.encode()) > POLICY_BYTES:
        raise AdvisorError("the policy is too long")
    try:
        value = strict_json(raw)
    except SourceError as e:
        raise AdvisorError(str(e)) from e
    if not isinstance(value, dict) or set(value) != {"policy", "bin_boosts"} or value["policy"] not in POLICIES or not isinstance(value["bin_boosts"], list) or len(value["bin_boosts"]) > MOST_BOOSTS:
        raise AdvisorError("not a policy")
    found: dict[str, float] = {}
    for b in value["bin_boosts"]:
        if not isinstance(b, dict) or set(b) != {"bin_id", "boost"} or b["bin_id"] in found or b["bin_id"] not in bins or isinstance(b["boost"], bool) or b["boost"] not in BOOSTS:
            raise AdvisorError("a boost is unknown or repeats")
        found[b["bin_id"]] = float(b["boost"])
    return value["policy"], found


def _canonical(value: Any) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":")).encode()


def check_decision(record: Mapping[str, Any], answer: tuple[str, dict[str, float]], bins: set[str], seed: int, runtime: Mapping[str, Any]) -> dict[str, Any]:
    """The record as a row of the journal, if it is of this answer, this seed and this runtime; anything else raises."""
    policy, boosts = check_policy(_canonical({"policy": answer[0], "bin_boosts": [{"bin_id": k, "boost": v} for k, v in answer[1].items()]}), bins)
    latencies = [float(x) for x in record.get("attempt_latencies", ())]
    resident = record.get("resident_bytes", 0)
    if record.get("seed") != seed or record.get("policy") != policy or record.get("boosts") != boosts or record.get("runtime", runtime) != runtime:
        raise AdvisorError("the decision's record is of another answer, seed or runtime")
    if not 1 <= len(latencies) <= CALLS or not all(0 <= x < float("inf") for x in latencies) or not isinstance(resident, int) or isinstance(resident, bool) or resident < 0:
        raise AdvisorError("the decision's record has no sound figures")
    digests = {k: str(record.get(k, "")) for k in ("request_digest", "response_digest")}
    return {"seed": seed, "policy": policy, "boosts": boosts, "runtime": _canonical(runtime).decode(), "attempt_latencies": latencies, "resident_bytes": resident, **digests}


def advisor_report(decisions: list[Mapping[str, Any]], most_bytes: int) -> dict[str, Any]:
    """Figures of a run's stored decisions, and whether latency and memory stay within their bounds."""
    latencies = [x for d in decisions for x in d["attempt_latencies"]]
    slowest, resident = max(latencies, default=0.0), max((d["resident_bytes"] for d in decisions), default=0)
    return {
        "decisions": len(decisions), "attempts": len(latencies), "total_latency_ms": sum(latencies), "maximum_latency_ms": slowest, "maximum_resident_bytes": resident,
        "policies": [d["policy"] for d in decisions], "latency_passed": slowest <= LATENCY_MS, "memory_passed": resident <= (most_bytes or MEMORY_BYTES),
    }


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_: Any, **__: Any) -> None:
        return None


class HttpTransport:
    """Plain HTTP to a literal loopback address, without proxies and redirects."""

    def __init__(self, endpoint: str) -> None:
        self.endpoint = Advisor(endpoint=endpoint).endpoint.rstrip("/")
        self.opener = urllib.request.build_opener(urllib.request.ProxyHandler({}), _NoRedirect)

    def request(self, method: str, path: str, payload: bytes | None, timeout: float, most: int) -> bytes:
        asked = urllib.request.Request(self.endpoint + path, payload, {"Content-Type": "application/json"}, method=method)
        try:
            with self.opener.open(asked, timeout=timeout) as r:
                raw = r.read(most + 1)
        except OSError as e:
            raise AdvisorError(f"the advisor can't be reached: {e}") from e
        if len(raw) > most:
            raise AdvisorError("the answer is too long")
        return raw


class LocalAdvisor:
    """Asks a local model server; the version and the model's digest must be the configured ones, or nothing is used."""

    def __init__(self, settings: Advisor, transport: Transport | None = None) -> None:
        self.settings, self.transport = settings, transport or HttpTransport(settings.endpoint)
        self.records: list[dict[str, Any]] = []

    def _ask(self, method: str, path: str, payload: bytes | None = None) -> tuple[dict[str, Any], bytes]:
        raw = self.transport.request(method, path, payload, self.settings.timeout_s, ANSWER_BYTES)
        if len(raw) > ANSWER_BYTES:
            raise AdvisorError("the answer is too long")
        try:
            value = strict_json(raw)
        except SourceError as e:
            raise AdvisorError(f"{path}: {e}") from e
        if not isinstance(value, dict):
            raise AdvisorError(f"{path}: not an object")
        return value, raw

    def _own(self, path: str) -> dict[str, Any]:
        """The one entry of a list of models that is the configured one, with its digest."""
        listed = self._ask("GET", path)[0].get("models", [])
        own = [m for m in listed if isinstance(m, dict) and self.settings.model in (m.get("name"), m.get("model"))] if isinstance(listed, list) else []
        if len(own) != 1 or str(own[0].get("digest", "")).removeprefix("sha256:") != self.settings.digest:
            raise AdvisorError(f"{path}: the advisor isn't the one configured")
        return own[0]

    def verify(self) -> dict[str, Any]:
        """What answers: raises unless version, model, digest and a named quantization are the configured ones."""
        version, own = self._ask("GET", "/api/version")[0].get("version"), self._own("/api/tags")
        if version != self.settings.version:
            raise AdvisorError("the advisor isn't the one configured")
        details = own.get("details")
        level = details.get("quantization_level") if isinstance(details, dict) else None
        if self.settings.quantization and level != self.settings.quantization:
            raise AdvisorError(f"the advisor's model has quantization {level}")
        found = {"version": version, "model": self.settings.model, "digest": self.settings.digest}
        return found | ({"quantization": level} if self.settings.quantization else {})

    def _resident(self) -> int:
        """Bytes that the model has in memory, above most_bytes an error; not asked (0) where that is 0."""
        if not self.settings.most_bytes:
            return 0
        size = self._own("/api/ps").get("size")
        if isinstance(size, bool) or not isinstance(size, int) or not 0 < size <= self.settings.most_bytes:
            raise AdvisorError(f"the advisor's model has {size} bytes in memory")
        return size

    def advise(self, summary: Mapping[str, Any], bins: set[str], seed: int) -> tuple[str, dict[str, float]]:
        check_summary(summary)
        runtime = self.verify()
        system = "Answer with one policy and at most three bin boosts from the lists given."
        messages = [{"role": "system", "content": system}, {"role": "user", "content": json.dumps(summary, sort_keys=True)}]
        asked = _canonical({"model": self.settings.model, "stream": False, "format": policy_schema(), "options": {"seed": seed, "temperature": 0, "num_predict": 128}, "messages": messages})
        error: AdvisorError | None = None
        latencies: list[float] = []
        for _ in range(CALLS):
            start = time.perf_counter()
            try:
                answer, raw = self._ask("POST", "/api/chat", asked)
                message = answer.get("message")
                found = check_policy(str(message.get("content", "")) if isinstance(message, dict) else "", bins)
            except AdvisorError as e:
                error = e
                continue
            finally:
                latencies.append((time.perf_counter() - start) * 1000)
            digests = {"request_digest": hashlib.sha256(asked).hexdigest(), "response_digest": hashlib.sha256(raw).hexdigest()}
            self.records.append({"seed": seed, "policy": found[0], "boosts": found[1], "attempt_latencies": latencies, "runtime": runtime, "resident_bytes": self._resident(), **digests})
            return found
        raise AdvisorError(f"no valid policy in {CALLS} answers: {error}")
