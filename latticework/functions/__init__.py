"""Column expressions, numpy kernels and helpers for grouped walks."""
