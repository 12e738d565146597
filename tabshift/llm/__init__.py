"""Training-data operators: licences, quality, fingerprints, mixing, decontamination, chat, HTML, dedup, token files."""
