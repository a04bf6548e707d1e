"""Training-data operators.  Nothing else in ``ripple`` imports this subpackage."""
