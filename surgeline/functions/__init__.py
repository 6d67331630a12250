"""Window functions over series."""
