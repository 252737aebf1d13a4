"""Operators of a training-data pipeline: corpus cleaning, mixing and packing.

Nothing outside this subpackage and `corpus_pipeline.py` imports it.
"""
