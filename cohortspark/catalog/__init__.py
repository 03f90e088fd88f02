"""Every operator run on the given tables, with the same result stated in SQL."""
