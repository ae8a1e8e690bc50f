"""Operators on training texts and usage logs.  Nothing else in the library imports this subpackage."""
