"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised here."""


class InvalidConfig(EngineError):
    """A parameter is out of its range, or vectors differ in dimension."""


class FeatureNotAvailable(EngineError):
    """An index does not offer the operation."""


class IncompatibleVersion(EngineError):
    """A file has another version or is no collection file."""
