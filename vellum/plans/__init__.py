"""Named application queries."""
