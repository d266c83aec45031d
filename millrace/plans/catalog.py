"""All registered queries."""

from millrace.plans import contracts, corpus, fleet, health, telemetry  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES  # noqa: F401
