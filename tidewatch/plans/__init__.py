"""Named queries by family; importing a family registers its queries."""

from tidewatch.plans.registry import QUERIES, SQL  # noqa: F401
from tidewatch.plans import checked, leakage, prepared, protocol, scored, sifted, stored, texts  # noqa: E402,F401
