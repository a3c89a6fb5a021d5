"""Training-data operators: quality, duplicates, contamination, packing and storage of text corpora."""
