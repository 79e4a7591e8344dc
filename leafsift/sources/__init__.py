"""Table schemas, readers, writers and the fixed seed tables."""
