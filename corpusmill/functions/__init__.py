"""Row-local column expressions: no shuffle, no Python worker, usable on streams."""
