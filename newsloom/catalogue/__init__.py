"""The registered queries: every operator on the given tables, with its SQL twin."""
