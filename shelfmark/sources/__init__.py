"""Page caches, discovery results, artifacts, exports and reports."""
