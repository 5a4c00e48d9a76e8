"""Logs folded as they grow. The states are those of the batch folds; nothing here has watermarks or late data."""
