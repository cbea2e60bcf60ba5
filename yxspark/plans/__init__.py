"""How a scan is cut into partitions."""
