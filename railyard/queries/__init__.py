"""Queries over the driver's tables, each with its SQL. A module for each part of the library."""
