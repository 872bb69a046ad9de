"""Finding, scoring, correlation, clustering and graph operators."""
