"""Streams, archives, replays and generated ticks."""
