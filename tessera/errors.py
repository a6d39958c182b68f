"""Exceptions of the library."""

from __future__ import annotations


class Error(Exception):
    """Base of all others."""


class ConfigError(Error, RuntimeError):
    """A configuration is missing or wrong."""


class WorkspaceError(Error, OSError):
    """A workspace cannot be read or made."""


class DestinationExistsError(Error, RuntimeError):
    """Something with the same identity is there already."""

    def __init__(self, destination):
        super().__init__(destination)
        self.destination = destination


class JobsCorruptedError(Error, RuntimeError):
    """State points that cannot be read or do not hash to their ids."""

    def __init__(self, job_ids):
        super().__init__(job_ids)
        self.job_ids = list(job_ids)


class DocumentsCorruptedError(Error, RuntimeError):
    """Documents that cannot be read."""

    def __init__(self, job_ids):
        super().__init__(job_ids)
        self.job_ids = list(job_ids)


class StatepointParsingError(Error, RuntimeError):
    """A state point does not fit its source, or sources disagree."""


class IncompatibleSchemaVersion(Error):
    """A stored layout of another version."""


class InvalidKeyError(Error, ValueError):
    """A key holds a dot."""


class KeyTypeError(Error, TypeError):
    """A key is not a string."""


class SyncConflict(Error, RuntimeError):
    """Two sides differ and no strategy says which to keep."""


class FileSyncConflict(SyncConflict):
    def __init__(self, filenames):
        super().__init__(f"files differ: {filenames}")
        self.filenames = filenames


class DocumentSyncConflict(SyncConflict):
    def __init__(self, keys):
        super().__init__(f"document keys differ: {keys}")
        self.keys = keys


class SchemaSyncConflict(SyncConflict):
    def __init__(self, source, destination):
        super().__init__("the schemas differ")
        self.schema_src, self.schema_dst = source, destination


class StoreClosedError(Error, RuntimeError):
    """A store is used while it is closed."""


class StoreAlreadyOpenError(Error, OSError):
    """A store is opened twice."""
