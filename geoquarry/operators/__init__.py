"""DataFrame operators of the urban engine."""
