"""Conversation analytics as set-oriented Spark DataFrame programs."""
