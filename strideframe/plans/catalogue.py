"""All registered queries; importing a plan module registers its queries."""

from importlib import import_module

from .registry import ORACLES, QUERIES

FLAGSHIP = "room_query"
MODULES = (
    "scans", "scalars", "quality", "time_joins", "space_joins", "scale_fits", "surfaces", "scores",
    "series", "identity", "windows", "reports", "live", "room",
)
for _name in MODULES:
    try:
        import_module(f"{__package__}.{_name}")
    except ModuleNotFoundError as missing:
        if missing.name != f"{__package__}.{_name}":
            raise

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
