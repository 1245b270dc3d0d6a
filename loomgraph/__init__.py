"""Contract-graph analytics as DataFrame operators: scan, normalise, weigh, join, cluster, query, learn from feedback."""
