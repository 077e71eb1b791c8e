"""Column builders: vectors, predicates, text."""
