"""What the library raises."""

from __future__ import annotations


class PremiaError(Exception):
    """Any error of this library."""


class DomainValidationError(PremiaError, ValueError):
    """A row or a domain breaks its rules."""


class ConfigError(PremiaError, ValueError):
    """A configuration breaks its rules."""


class SourceError(PremiaError, ValueError):
    """A file or table isn't what its reader expects."""


class ProviderError(PremiaError):
    """A quote could not be had."""


class ProviderUnavailable(ProviderError):
    """A provider raises it for a failure that may pass; the call is repeated."""


class ProviderRejected(ProviderError):
    """A provider failed for good, or answered with what isn't a premium."""


class JournalError(PremiaError):
    """The journal doesn't allow a step or has been tampered with."""


class RunLocked(JournalError):
    """Another process works on the run."""


class ModelSelectionError(PremiaError):
    """No candidate is fast enough."""


class ArtifactError(PremiaError):
    """An artifact is incomplete, altered or inconsistent."""


class LegacyArtifactError(ArtifactError):
    """An artifact of an older, unsupported form."""


class AdvisorError(PremiaError):
    """The policy advisor is unreachable or its answer breaks the contract."""
