"""Training-data operators: decontamination, URL filters, chat formatting, language ID, piece segmentation,
near-duplicates, nearest neighbours, secrets, main text of pages, sharding."""
