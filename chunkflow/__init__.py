"""Document processing on Spark: extraction, normalisation, chunking, model calls with retries, merging, layout."""
