"""Typed errors, by family."""


class ProvenaError(Exception):
    """Base of all errors of this package."""


class SourceError(ProvenaError):
    """Annotation sources."""


class SourceNotFound(SourceError):
    pass


class MalformedSource(SourceError):
    pass


class InvalidAnnotation(SourceError):
    pass


class InvalidBox(SourceError):
    pass


class BoxOutOfBounds(SourceError):
    pass


class FeatureError(ProvenaError):
    """Feature batches, extractors and their store."""


class StaleFeatures(FeatureError):
    pass


class WeightsNotFound(FeatureError):
    pass


class IncompatibleWeights(FeatureError):
    pass


class BackendUnavailable(FeatureError):
    pass


class DetectorError(ProvenaError):
    """Detector configuration or input."""


class AggregationError(ProvenaError):
    pass


class ProvenanceError(ProvenaError):
    pass


class CorruptAuditLog(ProvenaError):
    pass


class FindingError(ProvenaError):
    """Findings, snapshots and decisions."""
