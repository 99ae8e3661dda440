"""Column functions: calendar, radiometry and projections."""
