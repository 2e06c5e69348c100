"""Registered queries. Importing a plan module registers its queries."""

from importlib import import_module

MODULES = (
    "highlight_queries", "series_queries", "caption_queries", "timeline_queries", "library_queries", "camera_queries",
    "scalar_queries", "stream_queries",
)


def load_all() -> None:
    for module in MODULES:
        import_module(f"cuelattice.plans.{module}")
