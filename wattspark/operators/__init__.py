"""DataFrame operators. Each returns a lazily planned DataFrame (no actions)."""
