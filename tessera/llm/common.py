"""Helpers shared by the operators of this subpackage."""

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.storage import dropped, fewer, load, shared_dir, written

__all__ = ["claim", "dropped", "fewer", "load", "shared_dir", "whole_rows", "written"]
_CACHES: dict[str, Callable[[], None]] = {}


def whole_rows(docs: DataFrame) -> DataFrame:
    """One column ``row`` with all columns of docs inside, so that no name in docs clashes with a helper column."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))


def claim(name: str, forget: Callable[[], None]) -> None:
    """Called by an operator that keeps a cache in its Python worker: the other operators' caches there are emptied.

    Workers are used for one stage after another, so their memory is that of the largest cache and not the sum.
    """
    others = [n for n in _CACHES if n != name]
    for other in others:
        _CACHES.pop(other)()
    _CACHES[name] = forget
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
