"""Training-data operators: near duplicates, language, chat, URL rules, mixing, PII, licences, quality, leaks."""
