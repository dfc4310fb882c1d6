"""Training-data operators: one module each, with the queries that apply them in `queries`."""
