"""Column functions over message texts and statistics."""
