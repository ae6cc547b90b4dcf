"""Jobs: the operators as queries over the given tables."""
