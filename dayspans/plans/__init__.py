"""Named queries over the operators, each with its SQL twin where SQL can express it."""
