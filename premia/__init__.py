"""A PySpark-native engine that learns, evaluates and serves a surrogate of a quote function."""

from importlib import import_module
from typing import Any

#: Public names by the module that has them; each is imported when it is first asked for, as workers need few of them.
_PLACES = {
    "advisor": ("PolicyAdvisor",),
    "config": ("Acquisition", "Advisor", "Artifact", "Config", "EarlyStopping", "Evaluation", "Model", "ProviderSettings", "Sampling", "load_config"),
    "engine": ("Prediction", "PricingEngine"),
    "errors": (
        "AdvisorError", "ArtifactError", "ConfigError", "DomainValidationError", "JournalError", "LegacyArtifactError", "ModelSelectionError",
        "PremiaError", "ProviderError", "ProviderRejected", "ProviderUnavailable", "RunLocked", "SourceError",
    ),
    "operators.acquire": ("AcquisitionScore",),
    "provider": ("Provider", "quote"),
    "run": ("MappingRun", "Result"),
    "schema": ("Domain",),
}
_MODULES = {name: module for module, names in _PLACES.items() for name in names}
__all__ = sorted(_MODULES)
__version__ = "0.1.0"


def __getattr__(name: str) -> Any:
    if name not in _MODULES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_MODULES[name]}"), name)
