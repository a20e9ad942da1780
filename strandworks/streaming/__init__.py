"""Running results over arriving calls. The batch operators do not need it."""
