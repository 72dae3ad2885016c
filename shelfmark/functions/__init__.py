"""Column functions: text, urls, prices, pack sizes, JSON, identity."""
