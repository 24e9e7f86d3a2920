"""Importing this module registers every query."""

from clausegrid.catalog import browse, graph, models, questions, retrieval, streams, structure  # noqa: F401
