"""Tables: readers, writers and the deterministic estate derived from the given tables."""
