"""Operators for building training data: clean, deduplicate, label, mix, shard and archive documents."""
