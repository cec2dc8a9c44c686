"""Feeds: event-time windows, alerts, de-duplication, keyed state."""
