"""Training-data operators: formatting, cleaning, packing, scoring, tokenising and deduplication at corpus scale."""
