"""Column-level building blocks shared by batch and streaming."""
