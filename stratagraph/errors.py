"""Errors of the engine. Each names a data-level refusal."""


class EngineError(Exception):
    pass


class QueryError(EngineError):
    """A condition or window that can't be answered as written."""


class NotAnEntity(EngineError):
    pass


class UniqueViolation(EngineError):
    pass


class SchemaMismatch(EngineError):
    pass


class SchemaSkew(EngineError):
    """Two live declarations of one type disagree."""


class Conflict(EngineError):
    """The records changed since they were read."""


class MixedTemporal(EngineError):
    """A field mixes times with and without zone."""


class DanglingRef(EngineError):
    pass


class DeletedEntity(EngineError):
    pass


class FrozenEntity(EngineError):
    """An update of an append-only type."""


class UnknownActor(EngineError):
    pass


class SponsorRequired(EngineError):
    pass


class WriteDenied(EngineError):
    pass


class ReadDenied(EngineError):
    pass


class StoreLocked(EngineError):
    pass


class NewerStore(EngineError):
    pass


class CorruptRecord(EngineError):
    pass


class DeltaGap(EngineError):
    pass


class DeltaFormat(EngineError):
    pass


class ConfigDrift(EngineError):
    """A consumer's folder was built with another configuration."""


class UnseenType(UserWarning):
    """A read of a type that was never committed; its result is empty."""
