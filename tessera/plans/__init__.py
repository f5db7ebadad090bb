"""Registered queries and their SQL twins, one module for each family."""
