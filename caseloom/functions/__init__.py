"""Column helpers and skew-safe building blocks shared by the operators."""
