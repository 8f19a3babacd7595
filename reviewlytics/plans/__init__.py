"""The queries a caller runs: scoring, views, search, sentiment, mining."""
