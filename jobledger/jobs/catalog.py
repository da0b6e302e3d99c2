"""All registered queries: batch and streaming."""

from jobledger.jobs import registry, streams  # noqa: F401

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
