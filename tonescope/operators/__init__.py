"""DataFrame operators: contracts, near duplicates, splits, statistics, labels, models, delivery."""
