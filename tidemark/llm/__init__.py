"""Operations for preparing training data for language models.

Nothing outside this subpackage imports it: it can be deleted together with
``tests/llm`` and ``corpus_pipeline.py`` and the rest keeps working.
"""
