"""Report queries and the composed audit run."""
