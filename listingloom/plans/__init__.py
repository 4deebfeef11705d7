"""Run planning, read views, and the bindings of the driver's tables."""
