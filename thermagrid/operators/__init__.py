"""Operators over pixel tables (date, row, col, value); each is a function from DataFrame to DataFrame."""
