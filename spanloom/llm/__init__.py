"""Operators that prepare text corpora for model training.

Nothing else in the library imports this subpackage; it needs only pyspark,
pyarrow and numpy (packing also needs ``tokenizers``).
"""
