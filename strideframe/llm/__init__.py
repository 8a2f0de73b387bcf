"""Operations of a training-data pipeline: mixing, near-duplicates, archives, filters, search."""
