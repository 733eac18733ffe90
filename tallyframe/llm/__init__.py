"""Training-data operators: mixing, toxicity, search, packing, URL lists, sharding, joins, chat, PII, media."""
