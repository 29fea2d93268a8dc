"""Operators on practice records."""
