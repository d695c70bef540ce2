"""Scalar functions with PostgreSQL's semantics, as Column expressions; Python only where no expression can say it."""
