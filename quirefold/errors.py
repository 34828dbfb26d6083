"""Errors of the library; on a corpus they become error_class and error columns unless fail_fast asks for raising."""


class QuireError(Exception):
    """Base of all expected errors."""


class InputError(QuireError):
    """A path, option or suffix that can't be used."""


class DocumentReadError(QuireError):
    """A document that can't be read."""


class PageReadError(DocumentReadError):
    """Pages that can't be read."""


class NoTextError(PageReadError):
    """A document without any text."""


class ZoneReadError(DocumentReadError):
    """Text zones that can't be read."""


class OcrError(QuireError):
    """Recognition failed or its output is malformed."""


class MissingDependencyError(QuireError):
    """A tool or library that an adapter needs isn't there."""


class ArchiveReadError(QuireError):
    """An archive that isn't a sound publication."""


class ArchiveWriteError(QuireError):
    """A publication that can't be written."""


class RepairError(QuireError):
    """A repair that failed."""


class ValidationError(RepairError):
    """A repaired publication that the validator still rejects."""
