"""Column expressions over the feature schema."""
