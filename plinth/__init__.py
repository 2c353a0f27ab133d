"""Batch and streaming data operators for knowledge corpora and event logs, as Spark DataFrame plans."""
