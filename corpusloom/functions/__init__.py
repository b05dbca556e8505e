"""Column functions over texts and arrays."""
