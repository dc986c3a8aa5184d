"""Functions of one's own: Arrow-batched pandas functions, table functions and SQL functions."""
