"""Where facts come from: logs of facts, and tables shown as attributes."""
