"""Training-data operators: quality, secrets, licences, decontamination, mixing, near-duplicates,
fingerprints, chat collapse, token counts and URL filters.  Nothing else in the library imports this."""
