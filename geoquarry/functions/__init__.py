"""Column builders: geometry and domain classifiers."""
