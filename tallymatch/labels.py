"""The status every row or asset ends with, and the groups the statuses fall into."""

# Fixed values.
APPLIED = "APPLIED"
PLANNED = "PLANNED"
ALREADY_DONE = "ALREADY_DONE"
BLANK_KEY = "BLANK_KEY"
BLANK_TARGET = "BLANK_TARGET"
INVALID_TARGET = "INVALID_TARGET"
DUPLICATE_KEY = "DUPLICATE_KEY"
DUPLICATE_TARGET = "DUPLICATE_TARGET"
NO_ASSET = "NO_ASSET"
DUPLICATE_ASSET = "DUPLICATE_ASSET"
TARGET_CONFLICT = "TARGET_CONFLICT"
COPY_FAILED = "COPY_FAILED"
ORPHAN_ASSET = "ORPHAN_ASSET"

ALL = (
    APPLIED, PLANNED, ALREADY_DONE, BLANK_KEY, BLANK_TARGET, INVALID_TARGET, DUPLICATE_KEY, DUPLICATE_TARGET, NO_ASSET,
    DUPLICATE_ASSET, TARGET_CONFLICT, COPY_FAILED, ORPHAN_ASSET,
)
SUCCESS = (APPLIED, PLANNED, ALREADY_DONE)

# Outcome codes of a run. One that is not fit raises instead.
CODE_OK = 0
CODE_ATTENTION = 2
