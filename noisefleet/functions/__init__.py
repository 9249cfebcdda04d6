"""Column builders and driver-side naming rules."""
