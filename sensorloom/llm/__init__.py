"""Training-data operators: dedup, scoring, classification, decontamination, tokenising, licences."""
