"""Conversation working-set analytics on Spark."""
