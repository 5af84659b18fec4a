"""Session helpers and physical-plan building blocks shared by the operators."""
