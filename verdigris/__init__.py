"""Test-impact and flaky-test analytics on Spark."""
