"""DataFrame -> DataFrame operators (tree, ranking, enrichment, stats, memo, report)."""
