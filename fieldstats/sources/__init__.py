"""Reading tables, flattening arrays, and writing results."""
