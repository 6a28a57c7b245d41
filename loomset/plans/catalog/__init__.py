"""Every query over the test tables, by name, with the SQL that must give the same rows."""

from loomset.plans.catalog import (  # noqa: F401
    answers,
    chats,
    datasets,
    idle,
    inference,
    pairs,
    selection,
)
from loomset.plans.catalog.registry import CATALOG

__all__ = ["CATALOG"]
