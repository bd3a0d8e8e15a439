"""The public queries, composed of operators."""
