"""Crawl events as a stream."""
