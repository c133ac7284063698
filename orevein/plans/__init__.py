"""Views of the star schema, the queries by name, and their SQL twins."""
