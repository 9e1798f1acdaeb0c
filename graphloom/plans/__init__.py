"""The engine's queries by name; importing the package registers all of them."""

from . import catalog, chunk_queries, community_queries, context_queries, graph_queries, index_queries, modal_queries, question_queries, queue_queries, response_queries, state_queries  # noqa: F401
