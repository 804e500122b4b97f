"""DataFrame operators: passages, index, ranking, tags, statistics, checks."""
