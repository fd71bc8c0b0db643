"""Errors with a code, a message and details."""

from __future__ import annotations

# The codes that callers match on, and the exit status of each.
CONFIG_INVALID = "CONFIG_INVALID"
INPUT_INVALID = "INPUT_INVALID"
ENTITY_NOT_FOUND = "ENTITY_NOT_FOUND"
FACT_NOT_FOUND = "FACT_NOT_FOUND"
SOURCE_NOT_FOUND = "SOURCE_NOT_FOUND"
LIFECYCLE_INVALID = "LIFECYCLE_INVALID"
QUERY_FAILED = "QUERY_FAILED"
NOT_SUPPORTED = "NOT_SUPPORTED"
EXIT_STATUS = {
    CONFIG_INVALID: 2,
    INPUT_INVALID: 2,
    LIFECYCLE_INVALID: 2,
    NOT_SUPPORTED: 2,
    ENTITY_NOT_FOUND: 3,
    FACT_NOT_FOUND: 3,
    SOURCE_NOT_FOUND: 3,
    QUERY_FAILED: 4,
}


class RecordError(Exception):
    """What an operation raises when its request or the memory's state does not allow it."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}" + (f" {details}" if details else ""))
        self.code, self.message, self.details = code, message, details

    @property
    def exit_status(self) -> int:
        return EXIT_STATUS.get(self.code, 1)
