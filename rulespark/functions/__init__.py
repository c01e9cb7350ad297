"""Column expressions; no Python runs on executors unless a function says so."""
