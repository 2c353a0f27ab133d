"""Column expressions that operators share."""
