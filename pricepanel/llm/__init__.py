"""Training-data operators: scans, filters, joins, packing and encodings over text tables."""
