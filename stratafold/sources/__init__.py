"""Sources, sinks and the layer tables."""
