"""Column expressions and grouped-order primitives shared by the operators."""
