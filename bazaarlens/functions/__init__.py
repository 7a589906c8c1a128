"""Column helpers and small distributed algorithms shared by the operators."""
