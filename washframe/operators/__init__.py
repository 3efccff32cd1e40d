"""DataFrame -> DataFrame operators: fit in bounded aggregations, apply as projections."""
