"""Column builders (Catalyst expressions) and NumPy kernels (no Spark import)."""
