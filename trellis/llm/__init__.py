"""Training-data operators: thirteen operators and their registered queries."""
