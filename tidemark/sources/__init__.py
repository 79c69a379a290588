"""Reading and writing tables, partitions and side files."""
