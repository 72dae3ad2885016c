"""Registered queries and their reference statements."""

from . import catalog, comparison, crawl, scans, sources, structured, texts  # noqa: F401  (they register their queries)
from . import reports  # noqa: F401, E402  (over those)
