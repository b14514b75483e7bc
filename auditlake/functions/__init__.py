"""Column-level building blocks and the fixed rule values they use."""
