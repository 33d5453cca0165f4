"""Event-time windows and stateful log views; each batch function also takes a streaming DataFrame."""
