"""From SPARQL text to algebra, and rewrites of it."""
