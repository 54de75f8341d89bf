"""What a Python worker keeps between tasks.

Spark gives idle workers to the tasks of any later stage. So that dictionaries of one operator don't stand beside the
arrays of the next one, a task that begins names its owner: what others kept in this worker goes.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa

_KEPT: dict[str, dict] = {}
_LAST: list[str] = []


def kept(owner: str) -> dict:
    """The owner's store in this worker; another owner's store and the memory that its tasks freed are given back first."""
    if _LAST != [owner]:
        for other in [o for o in _KEPT if o != owner]:
            del _KEPT[other]
        _LAST[:] = [owner]
        pa.default_memory_pool().release_unused()
        # numpy's freed arrays stay with the C library unless it is told to return them; not every library can
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    return _KEPT.setdefault(owner, {})
