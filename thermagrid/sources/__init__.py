"""Scans and sinks of grids, and the tables that tests derive grids from."""
