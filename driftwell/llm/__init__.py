"""Training-data operators: one module each; ``registry`` lists their queries."""
