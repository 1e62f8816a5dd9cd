"""The registered queries and their SQL."""

from sievewright.plans import catalog, console, indexes, intake, leasing, matching, nested, registry, scanning

__all__ = ["catalog", "console", "indexes", "intake", "leasing", "matching", "nested", "registry", "scanning"]
