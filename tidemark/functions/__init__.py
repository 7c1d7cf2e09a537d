"""Column expressions: text, numbers, calendars, price events and JSON."""
