"""The engine of verbs, and the registered queries with their SQL."""
