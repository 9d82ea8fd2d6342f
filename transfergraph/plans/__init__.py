"""Plan-building helpers: cutting lineage, iteration, range joins."""
