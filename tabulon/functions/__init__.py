"""Column-expression helpers (JVM-side) and small scalar maths."""
