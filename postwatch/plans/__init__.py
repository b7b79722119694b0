"""Whole pipelines: the daily digest, one poll for new subscriptions, page triage."""
