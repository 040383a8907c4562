"""Registered queries over the driver's tables; importing any of these modules registers all of them."""

from . import (  # noqa: F401
    event_queries,
    extraction_queries,
    listing_queries,
    memory_queries,
    note_queries,
    prompt_queries,
    session_queries,
    state_queries,
    store_queries,
    stream_queries,
)
