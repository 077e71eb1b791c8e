"""Reading and writing tables, indexes and logs."""
