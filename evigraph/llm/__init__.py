"""Training-data operators: near-duplicate detection, language identification, tokenisation and the like.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
