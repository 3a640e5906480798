"""All registered queries and their checking SQL."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import grading_queries, replay_queries, stream_queries, world_queries, file_queries, asof_queries  # noqa: F401
