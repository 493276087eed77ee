"""Column expressions: calendar, distance, text and number helpers."""
