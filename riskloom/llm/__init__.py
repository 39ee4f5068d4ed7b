"""Training-data operators: ten text operators and their queries. Nothing else in the package imports this folder."""
