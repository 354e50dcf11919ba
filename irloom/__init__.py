"""A Spark engine for a relational model of source-code documentation."""
