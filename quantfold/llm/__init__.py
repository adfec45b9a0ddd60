"""Training-data pipeline operators (language id, toxicity, token files, near-duplicates, search,
substring removal, personal data, packing, decontamination, HTML extraction).

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
