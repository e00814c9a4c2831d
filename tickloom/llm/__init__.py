"""Training-data operators: text in, decisions out. Nothing outside this package imports it."""
