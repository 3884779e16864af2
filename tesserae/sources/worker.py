"""Things that a Python worker keeps from task to task."""

from __future__ import annotations

import ctypes
import glob
import os
import sys
import types
from collections.abc import Callable
from typing import Any

import numpy as np


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make()`` gave the first time this process was asked for ``key``.

    Functions of this package travel by value, with globals of their own in each task, so that what outlives a
    task is kept in a module of the process itself. Meant for a few tables of fixed size; ``key`` must name
    their whole content.
    """
    store = sys.modules.setdefault("tesserae_kept", types.ModuleType("tesserae_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def one_core() -> None:
    """Has numpy compute this process's matrix products on one core, as a task is given one; where its library can't be told, nothing happens."""

    def tell() -> bool:
        for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
            try:
                library = ctypes.CDLL(path)
            except OSError:
                continue
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)
        return True

    kept(("one core",), tell)
