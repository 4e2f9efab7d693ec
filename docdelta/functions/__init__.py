"""Column -> Column functions of the comparison engine."""
