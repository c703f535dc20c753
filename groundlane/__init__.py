"""Spark-native engine for document-grounding data: curation, splits, prompts, boxes, image geometry, batches and training logs."""
