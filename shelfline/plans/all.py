"""Imports every plan module, which registers its queries."""

from shelfline.plans import (  # noqa: F401
    accounts,
    expressions,
    inventory,
    lifetime,
    marketing,
    sales,
    service,
    summaries,
    trends,
    vocabulary,
)
from shelfline.plans.registry import QUERIES  # noqa: F401
