"""Registered queries by theme, each with SQL that must give the same rows."""
