"""Plan-building helpers shared by the operators."""
