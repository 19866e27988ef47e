"""The registered queries."""

from tidewire.plans import discovery, live, messages, payloads, rates, recordings  # noqa: F401
from tidewire.plans.registry import QUERIES, SQL  # noqa: F401
