"""Event-time streaming statistics, alerts and micro-batch processing."""
