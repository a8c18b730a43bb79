"""What can go wrong with tables."""


class TidemarkError(Exception):
    """Base of all errors raised here."""


class SchemaError(TidemarkError):
    """A schema or a change of one that isn't allowed."""


class TableExists(TidemarkError):
    pass


class TableMissing(TidemarkError):
    pass


class VersionMissing(TidemarkError):
    """Time travel to before the first version or beyond the last."""


class CommitConflict(TidemarkError):
    """Another commit changed what this one relies on."""


class LogCorrupt(TidemarkError):
    """An entry that can't be read, or whose parent checksum doesn't match."""


class ProtocolError(TidemarkError):
    """The table needs a newer reader or writer."""


class MergeError(TidemarkError):
    """A source key that occurs more than once, in strict mode."""


class FormatError(TidemarkError):
    """A file format that can't be read or written."""
