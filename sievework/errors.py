"""Errors, raised on the driver while a plan is built."""


class ExtractionError(Exception):
    """Base of all errors of this package."""


class SchemaError(ExtractionError, ValueError):
    """A schema that cannot be used."""


class ValidationError(SchemaError):
    """A value of a schema element out of its range."""


class PatternError(SchemaError):
    """A regular expression of a validator that does not compile."""


class ConfigError(ExtractionError, ValueError):
    """A configuration that cannot be used."""


class WeightsError(ExtractionError):
    """A weight file that is missing, damaged or of the wrong shape."""


class CapabilityError(ExtractionError):
    """The scorer lacks a head that the schema asks for; names the scorer."""

    def __init__(self, scorer: str, head: str):
        super().__init__(f"scorer {scorer!r} has no {head} head; choose one that has, or leave {head} out of the schema")
        self.scorer, self.head = scorer, head


class ChunkingError(ExtractionError, ValueError):
    """Chunk sizes that make no progress."""
