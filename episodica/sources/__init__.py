"""Readers and writers: metric logs, records, manifests, arrays, and the folder that driver and executors share."""
