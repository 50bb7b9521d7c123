"""Column functions with the exact semantics the workloads need."""
