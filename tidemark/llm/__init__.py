"""Training-data operators: one module per operator, plus the queries that apply them to whole tables."""
