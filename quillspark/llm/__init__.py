"""Operators of a training-data pipeline at corpus scale. Nothing outside this folder imports it."""
