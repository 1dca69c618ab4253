"""A PySpark engine for nearest-neighbour graphs, searches and partitions of vectors."""
