"""All queries of this subpackage."""

from . import queries_codes, queries_links, queries_models, queries_phrases, queries_repeats, queries_tables  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
