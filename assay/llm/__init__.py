"""Training-data operators: one module per operator, one query module for the registry."""
