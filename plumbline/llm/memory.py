"""Memory of Python workers, which stay alive between tasks and hold what they once took."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Give memory that is free back to the system; called where a task ends, as the worker then waits for the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator
        pass
