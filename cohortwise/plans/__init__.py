"""Complete analyses: the operators applied to a set of tables."""
