"""plans of the timeline engine."""
