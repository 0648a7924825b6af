"""What can go wrong, by kind."""


class EngineError(Exception):
    """Any error of this engine."""


class ConfigError(EngineError):
    """The configuration can't be read."""


class IoError(EngineError):
    """A file can't be read or written."""


class SerializationError(EngineError):
    """A value can't be encoded or decoded."""


class SqlParseError(EngineError):
    """The statement isn't understood."""


class ConstraintViolation(EngineError):
    """Rows break a constraint; the statement changed nothing."""


class UnsupportedError(EngineError):
    """The statement is understood but not offered."""


class TransactionError(EngineError):
    """The transaction is unknown or over."""


class SchemaError(EngineError):
    """A table, column or index is missing or exists already."""


class StorageError(EngineError):
    """The stored tables are inconsistent."""


class TriggerError(EngineError):
    """A trigger's definition or body fails."""


class ViewError(EngineError):
    """A view's definition fails."""


class JsonError(EngineError):
    """A JSON argument is malformed."""


class FtsError(EngineError):
    """A full-text query names something that isn't indexed."""
