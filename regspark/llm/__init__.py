"""Operators that prepare text for training language models.

Each module holds one operator, its production query and, where SQL can express it, the query's
SQL. Nothing outside this subpackage imports it.
"""


def registry():
    """``(name, query, sql or None)`` of every operator."""
    from regspark.llm import (
        bpe,
        chat_format,
        collocations,
        decontaminate,
        langid,
        line_dedup,
        lm_score,
        near_dedup,
        shard,
        simhash,
        token_align,
        topk,
        toxicity,
    )

    modules = (bpe, chat_format, shard, line_dedup, lm_score, decontaminate, langid, topk, toxicity, near_dedup, token_align, simhash, collocations)
    return [(m.NAME, m.query, m.ORACLE_SQL) for m in modules]


def queries():
    return {name: query for name, query, _ in registry()}


def oracle_sql():
    return {name: sql for name, _, sql in registry() if sql}
