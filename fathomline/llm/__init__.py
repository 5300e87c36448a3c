"""Training-data operators: tokenizing, deduplication, decontamination, language, licences, PII, HTML and quality.

Nothing outside this subpackage imports it.
"""
