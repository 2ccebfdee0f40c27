"""Tables of nodes, reports and ranges files."""
