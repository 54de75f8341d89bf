"""Names for inner columns that a caller's table does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(frame: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, lengthened by underscores until no column of frame has them (in any case)."""
    taken, found = {c.lower() for c in frame.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
