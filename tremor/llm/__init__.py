"""Training-data operators: decontamination, language, scoring, dedup, licences, search, quality, mixing, URLs."""
