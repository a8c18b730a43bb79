"""Column expressions: types, predicates, partition transforms, encoding analytics."""
