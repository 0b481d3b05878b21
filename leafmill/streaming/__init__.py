"""Event-time windows, admission control and incremental processing."""
