"""Named queries over the driver tables; importing the package registers them all."""

from . import event_queries, function_queries, link_queries, repo_queries, rollup_queries, session_queries, sink_queries, source_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
