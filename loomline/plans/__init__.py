"""Named queries, grouped by area."""

import importlib
import importlib.util

AREAS = ("panel", "indicators", "strategy", "risk", "work", "factors", "models", "streams", "api")


def load_all():
    from loomline.plans import registry

    for area in AREAS:
        if importlib.util.find_spec(f"loomline.plans.{area}_queries"):
            importlib.import_module(f"loomline.plans.{area}_queries")
    return registry
