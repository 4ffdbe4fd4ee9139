"""The session facade, and queries over the driver tables."""
