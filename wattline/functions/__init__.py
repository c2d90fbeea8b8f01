"""Column expressions: calendar, measures, hashes and forecast errors."""
