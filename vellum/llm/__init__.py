"""Training-data operators for large text tables; nothing else in the package imports this."""
