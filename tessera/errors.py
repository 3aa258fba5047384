"""What can be wrong with a statement."""


class DialectError(ValueError):
    """Any statement that can't be run."""


class BadSyntax(DialectError):
    """The text is not a statement of the dialect."""


class BadSemantics(DialectError):
    """The statement names or combines what the catalog does not have."""


class Conflict(DialectError):
    """Another writer has committed the version this one meant to write."""
