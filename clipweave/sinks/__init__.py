"""sinks of the timeline engine."""
