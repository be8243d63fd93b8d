"""Part of the ranking engine."""
