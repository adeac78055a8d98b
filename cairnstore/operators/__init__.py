"""DataFrame operators of the snapshot engine."""
