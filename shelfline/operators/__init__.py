"""Analytics operators: role DataFrames (plus ``as_of``) in, lazy DataFrame out."""
