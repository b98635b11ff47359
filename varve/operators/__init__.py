"""operators of the panel and market analytics engine."""
