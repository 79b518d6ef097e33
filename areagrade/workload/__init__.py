"""The operators bound to the star-schema tables, with an SQL statement for each."""
