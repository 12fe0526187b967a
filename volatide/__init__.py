"""volatide: news-driven volatility analytics and corpus processing on Spark DataFrames."""

import importlib

#: The parts that `volatide.NAME` gives when they are asked for.
_PARTS = {
    name: f"volatide.{group}.{name}"
    for group, names in {
        "operators": "alignment checks classify corpus frame garch labels reconcile residual sentiment stats volatility",
        "functions": "dates optimize text",
        "sources": "domain files providers sites",
        "streaming": "news",
        "plans": "catalogue flows",
    }.items()
    for name in names.split()
}
__all__ = sorted(_PARTS)


def __getattr__(name: str):
    if name in _PARTS:
        return importlib.import_module(_PARTS[name])
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
