"""The poll as a stream."""
