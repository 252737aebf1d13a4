"""DataFrame-in, DataFrame-out operators; import them from their modules."""
