"""What a Python worker keeps from one task to the next."""

import sys
import types


def kept(key, make):
    """make(), once for each worker and key. Functions that are shipped by value have no module of their own on an executor, so the objects live in one made for them."""
    module = sys.modules.get("_sweepframe_kept")
    if module is None:
        module = sys.modules["_sweepframe_kept"] = types.ModuleType("_sweepframe_kept")
        module.objects = {}
    if key not in module.objects:
        module.objects[key] = make()
    return module.objects[key]
