"""Reading originals and artifacts, and writing index batches."""
