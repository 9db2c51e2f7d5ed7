"""DataFrame operators: joins, ordered totals, quantiles, preparation, balancing, evaluation."""
