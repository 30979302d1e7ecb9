"""daygrid: entity-by-day metric panels, factor research and screening on Spark."""

from daygrid.config import Settings

__all__ = ["Settings"]
