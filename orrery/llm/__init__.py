"""Operators for training data whose problems are tagged llm."""
