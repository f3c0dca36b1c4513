"""Queries over the driver's tables; importing this package registers them."""

from . import document_queries, edit_queries, interval_queries, lane_queries, review_queries, sequence_queries, streaming_queries  # noqa: F401
