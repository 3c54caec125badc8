"""Imports every query module, which fills the catalog."""

from siteledger.plans import queries_core  # noqa: F401
from siteledger.plans import queries_health  # noqa: F401
from siteledger.plans import queries_recovery  # noqa: F401
from siteledger.plans import queries_packets  # noqa: F401
from siteledger.plans import queries_io  # noqa: F401
from siteledger.plans import queries_documents  # noqa: F401
from siteledger.plans.catalog import QUERIES  # noqa: F401
