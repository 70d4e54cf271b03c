"""Refrain: conversational recommendation and ranking as Spark DataFrame operators."""
