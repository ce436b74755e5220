"""Operators over script estates, mapping registries, document indexes and generated files."""
