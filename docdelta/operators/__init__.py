"""DataFrame -> DataFrame operators of the comparison engine."""
