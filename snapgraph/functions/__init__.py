"""snapgraph subpackage."""
