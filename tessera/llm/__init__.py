"""Training-data operators: packing, counting, joining, scanning and searching of whole corpora."""
