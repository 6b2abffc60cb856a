"""DataFrame operators: joins, windows and aggregations over long tables."""
