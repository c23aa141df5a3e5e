"""Building blocks shared by the operators: skew-safe joins, ordered sums, quantiles."""
