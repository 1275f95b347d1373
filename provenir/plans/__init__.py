"""Entry points that chain operators from input tables to a result table."""
