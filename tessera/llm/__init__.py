"""Training-data operators: toxicity, decontamination, quality, language model, tokens, rules, binary ids, near-dedup, shards, packing."""
