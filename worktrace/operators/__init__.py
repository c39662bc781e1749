"""DataFrame operators: lazy, DataFrame in and DataFrame out."""
