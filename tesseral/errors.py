"""Errors that the engine raises itself; those of Spark pass through."""


class QueryError(ValueError):
    """A query that can't be read or names what doesn't exist."""
