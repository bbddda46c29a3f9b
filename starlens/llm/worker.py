"""What a Python worker keeps between tasks: models and bounded caches.

Functions of this package travel by value, so their module's globals are new
in every task; a module made here stays in the worker. Losing it costs time
only: everything kept is made again from its key.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable

REGISTRY = "starlens_worker_registry"


def kept(name: str, key: Hashable, make: Callable):
    """``make()``, or what an earlier task of this worker made for ``key``;
    one value per ``name``."""
    held = sys.modules.setdefault(REGISTRY, types.ModuleType(REGISTRY)).__dict__.setdefault("values", {})
    if name not in held or held[name][0] != key:
        held[name] = (key, make())
    return held[name][1]
