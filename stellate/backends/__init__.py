"""The verbs: one module for each kind of configuration."""
