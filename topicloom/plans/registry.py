"""All registered queries."""

from __future__ import annotations

from topicloom.plans import captions, conversations, soft_topics, tables, text, topics, vectors
from topicloom.plans.base import Query

QUERIES: dict[str, Query] = {
    **captions.QUERIES,
    **tables.QUERIES,
    **text.QUERIES,
    **vectors.QUERIES,
    **topics.QUERIES,
    **soft_topics.QUERIES,
    **conversations.QUERIES,
}
