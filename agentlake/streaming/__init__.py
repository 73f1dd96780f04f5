"""Change feeds as streams: rows released at their commit, and sinks that may replay."""
