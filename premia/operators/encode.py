"""Encodings of quote rows: ordinal codes, scaled and one-hot columns, row keys, diagnostic bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from premia.errors import DomainValidationError
from premia.functions.numeric import clip
from premia.schema import CATEGORICAL, CONTINUOUS, FIELD_ORDER, NUMERIC, Domain

#: Bins of a numeric field in diagnostics.
NUMERIC_BINS = 4


def code(name: str, domain: Domain | None = None) -> Column:
    """A level's place among its field's levels; an unknown level raises when the row is read."""
    levels = (domain or Domain()).categorical[name]
    found = F.raise_error(F.concat(F.lit(f"{name}: unknown level "), F.coalesce(F.col(name), F.lit("null")))).cast("double")
    for i, level in reversed(list(enumerate(levels))):
        found = F.when(F.col(name) == level, F.lit(float(i))).otherwise(found)
    return found


def ordinal(domain: Domain | None = None) -> list[Column]:
    """The 15 fields as doubles under their own names."""
    return [(code(n, domain) if n in CATEGORICAL else F.col(n).cast("double")).alias(n) for n in FIELD_ORDER]


def feature_names(domain: Domain | None = None) -> list[str]:
    """The 23 columns of scaled_one_hot, in order."""
    domain = domain or Domain()
    return [*NUMERIC, *(f"{n}={level}" for n in CATEGORICAL for level in domain.categorical[n])]


def scaled_one_hot(domain: Domain | None = None) -> list[Column]:
    """v00 to v22: min-max scaled numbers, then a column for each level."""
    domain = domain or Domain()
    scaled = [(F.col(n).cast("double") - float(low)) / (float(high) - float(low)) for n, (low, high) in ((n, domain.numeric[n]) for n in NUMERIC)]
    hot = [F.when(F.col(n) == level, F.lit(1.0)).otherwise(F.lit(0.0)) for n in CATEGORICAL for level in domain.categorical[n]]
    return [c.alias(f"v{i:02d}") for i, c in enumerate([*scaled, *hot])]


def row_key() -> Column:
    """SHA-256 of the fields in alphabetical order; doubles count in millionths, so that no engine's number text matters."""
    parts = [F.rint(F.col(n) * 1e6).cast("long").cast("string") if n in CONTINUOUS else F.col(n).cast("string") for n in sorted(FIELD_ORDER)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def numeric_bin(name: str, domain: Domain | None = None) -> Column:
    low, high = (domain or Domain()).numeric[name]
    return F.least(F.floor(clip((F.col(name) - float(low)) / (float(high) - float(low)), 0.0, 1.0) * NUMERIC_BINS), F.lit(NUMERIC_BINS - 1).cast("long"))


def bin_ids(domain: Domain | None = None) -> Column:
    """The 15 bins that a row is in: v1:num:field:bin and v1:cat:field:level."""
    domain = domain or Domain()
    numeric = [F.concat(F.lit(f"v1:num:{n}:"), numeric_bin(n, domain).cast("string")) for n in NUMERIC]
    return F.array(*numeric, *(F.concat(F.lit(f"v1:cat:{n}:"), code(n, domain).cast("int").cast("string")) for n in CATEGORICAL))


def bin_catalogue(domain: Domain | None = None) -> list[str]:
    """Every bin id: 4 for each numeric field and one for each level."""
    domain = domain or Domain()
    return [f"v1:num:{n}:{i}" for n in NUMERIC for i in range(NUMERIC_BINS)] + [f"v1:cat:{n}:{i}" for n in CATEGORICAL for i in range(len(domain.categorical[n]))]


def encoder_metadata(domain: Domain | None = None) -> dict:
    """What an artifact stores of the encoding."""
    domain = domain or Domain()
    return {"version": 1, "fields": list(FIELD_ORDER), "features": feature_names(domain), "categorical": [n in CATEGORICAL for n in FIELD_ORDER], "domain": domain.to_dict()}


def check_metadata(raw: dict, domain: Domain) -> None:
    if raw != encoder_metadata(domain):
        raise DomainValidationError("the encoding stored isn't that of this domain")
