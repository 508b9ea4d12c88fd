"""The stateless operators and running counters on streams."""
