"""Operators of a training-data pipeline. Nothing else in keelson imports this subpackage."""
