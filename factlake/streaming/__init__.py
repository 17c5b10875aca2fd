"""Standing queries."""
