"""Running versions of the trailing-window counters, for event streams."""
