"""The registered queries and, for most, the same question as SQL."""
