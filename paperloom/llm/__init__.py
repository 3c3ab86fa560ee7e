"""Training-data operators: each module holds one operator, ``catalog`` their queries and SQL."""
