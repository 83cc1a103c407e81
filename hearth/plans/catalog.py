"""All queries of the library (the training-data operators have a registry of their own)."""

from hearth.plans import q_archive, q_cards, q_dedupe, q_facts, q_ingest, q_lifecycle, q_market, q_more, q_notes, q_pages, q_places, q_rows, q_search, q_sites, q_stream  # noqa: F401
from hearth.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
