"""Building blocks shared by the operators: wide aggregates, exact selection, ordered windows, value counts."""
