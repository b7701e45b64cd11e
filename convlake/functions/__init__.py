"""Column functions: expressions that Catalyst plans; no Python runs on a row."""
