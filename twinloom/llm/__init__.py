"""Operators of a training-data pipeline: near copies, personal data, pages,
benchmark overlap, language model, mixing, toxicity, token files, top-k, secrets."""
