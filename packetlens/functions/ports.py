"""Port features (inventory C16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ColumnLike, c

# Port class bounds and the common service ports.
WELL_KNOWN = (0, 1023)
REGISTERED = (1024, 49151)
DYNAMIC = (49152, 65535)
COMMON_SERVICE_PORTS = [20, 21, 22, 23, 25, 53, 80, 110, 123, 143, 161, 162, 443, 445, 514,
                        1883, 8883, 5683, 5684]


def port_features(col: ColumnLike, alias: str | None = None) -> list[Column]:
    """``{name}.category``, ``{name}.is_well_known``, ``{name}.is_common_service``.

    Category is well-known / registered / dynamic-private / invalid (null port
    included); the two flags stay null for a null port.
    """
    name = alias or (col if isinstance(col, str) else "port")
    p = c(col)
    category = (F.when(p.between(*WELL_KNOWN), "well-known")
                .when(p.between(*REGISTERED), "registered")
                .when(p.between(*DYNAMIC), "dynamic-private")
                .otherwise("invalid"))
    return [
        category.alias(f"{name}.category"),
        p.between(*WELL_KNOWN).alias(f"{name}.is_well_known"),
        p.isin(COMMON_SERVICE_PORTS).alias(f"{name}.is_common_service"),
    ]
