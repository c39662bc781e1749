"""Training-data operators: tokenising, quality, toxicity, language, deduplication, decontamination, sharding and HTML.

Nothing outside this subpackage imports it. Each module holds one operator (DataFrame in, DataFrame out);
``queries`` holds the thin registered queries and their SQL.
"""
