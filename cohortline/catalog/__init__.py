"""Named queries over the given tables, with the same result in SQL where SQL can express it."""
