"""Files of a store and of foreign logs."""
