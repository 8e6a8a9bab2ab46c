"""User quote functions: named, called row by row inside partitions with retries, every call on record."""

from __future__ import annotations

import importlib
import logging
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.errors import ConfigError, ProviderRejected, ProviderUnavailable
from premia.operators.encode import row_key
from premia.operators.tariff import premium
from premia.schema import FIELD_ORDER

log = logging.getLogger(__name__)
Quote = Callable[[dict[str, Any]], float]
_RESULT = "id long, row_key string, premium double, error string, attempts array<struct<number: int, outcome: string, latency_ms: double, error_type: string, at: string>>"
#: Name of the built-in tariff, which runs as a Column expression and is never called by row.
TARIFF = "premia:tariff"


@dataclass(frozen=True)
class Provider:
    call: Quote | None
    identity: str
    concurrency: int = 1


def resolve(target: str | Quote | None = None) -> Provider:
    """A provider from 'module:function', a callable, or nothing (the tariff).

    A callable may declare provider_id, thread_safe and max_concurrency; undeclared ones run one at a time.
    """
    if target is None or target == TARIFF:
        return Provider(None, TARIFF, 1 << 30)
    name = target if isinstance(target, str) else None
    if name is not None:
        if name.count(":") != 1:
            raise ConfigError("a provider is written module:function")
        module, attribute = name.split(":")
        try:
            target = getattr(importlib.import_module(module), attribute, None)
        except ImportError as e:
            raise ConfigError(f"{name}: {e}") from e
    if not callable(target):
        raise ConfigError(f"{name or target!r} can't be called")
    given = getattr(target, "provider_id", None)
    identity = given.strip() if isinstance(given, str) and given.strip() else name or f"{getattr(target, '__module__', '?')}:{getattr(target, '__qualname__', type(target).__qualname__)}"
    limit = getattr(target, "max_concurrency", 1)
    safe = getattr(target, "thread_safe", False) is True
    return Provider(target, identity, limit if safe and isinstance(limit, int) and limit > 0 else 1)


def valid_premium(raw: Any) -> float:
    if isinstance(raw, bool) or not isinstance(raw, int | float) or not math.isfinite(raw) or raw < 0:
        raise ProviderRejected("a premium must be a finite number, 0 or more")
    return float(raw)


def ask(call: Quote, row: dict[str, Any], retries: int, first: float, most: float, sleep: Callable[[float], None] = time.sleep) -> tuple[float | None, str | None, list[tuple]]:
    """(premium, error, attempts): ProviderUnavailable is tried again after a doubling pause, anything else is final."""
    attempts: list[tuple] = []
    for k in range(1, retries + 2):
        start, at = time.perf_counter(), datetime.now(UTC).isoformat()
        try:
            value, outcome, error = valid_premium(call(row)), "success", None
        except ProviderUnavailable as e:
            value, outcome, error = None, "retryable_failure", type(e).__name__
        except Exception as e:
            value, outcome, error = None, "permanent_failure", type(e).__name__
        if error is not None:
            log.warning("attempt %d of %d: %s (%s)", k, retries + 1, outcome, error)  # names the error's type alone, no payload
        attempts.append((k, outcome, (time.perf_counter() - start) * 1000, error, at))
        if outcome != "retryable_failure" or k == retries + 1:
            return value, error, attempts
        sleep(min(most, first * 2 ** (k - 1)))
    raise AssertionError("unreachable")


def quote(rows: DataFrame, provider: Provider, retries: int = 2, first: float = 0.05, most: float = 1.0) -> DataFrame:
    """rows (id and the 15 columns) to id, row_key, premium, error and attempts, which hold no payload.

    At most the provider's declared concurrency of calls run at once: tasks up to the cluster's slots, and threads in
    each of them for the rest. A task that Spark runs again asks again, as a crashed process would.
    """
    keyed = rows.select("id", row_key().alias("row_key"), *FIELD_ORDER)
    if provider.call is None:
        own = F.struct(F.lit(1).alias("number"), F.lit("success").alias("outcome"), F.lit(0.0).alias("latency_ms"), F.lit(None).cast("string").alias("error_type"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("at"))
        return keyed.select("id", "row_key", premium().alias("premium"), F.lit(None).cast("string").alias("error"), F.array(own).alias("attempts"))
    call = provider.call
    tasks = min(provider.concurrency, max(1, rows.sparkSession.sparkContext.defaultParallelism))
    threads = provider.concurrency // tasks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[list(FIELD_ORDER)].to_dict("records")
            if threads == 1:
                found = [ask(call, row, retries, first, most) for row in asked]
            else:
                with ThreadPoolExecutor(threads) as pool:
                    found = list(pool.map(lambda row: ask(call, row, retries, first, most), asked))
            attempts = [[dict(zip(("number", "outcome", "latency_ms", "error_type", "at"), a, strict=True)) for a in x[2]] for x in found]
            yield pd.DataFrame({"id": batch["id"], "row_key": batch["row_key"], "premium": [x[0] for x in found], "error": [x[1] for x in found], "attempts": attempts})

    spread = keyed.coalesce(1) if provider.concurrency == 1 else keyed.repartition(tasks)
    return spread.mapInPandas(run, _RESULT)
