"""Many strings looked for in many texts (ANA-1, ANA-2, AUD-3, AUD-9).

All asked strings make one automaton (Aho-Corasick), which a task builds once and runs over each text once: the
work is the length of the texts plus what is found, whatever the number of strings. Strings go to tasks in blocks
of bounded size, and texts stay where they are; there is no product of strings and texts.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of strings in a block, each of which reads the texts once more.
BLOCK = 16_000_000
_TOKEN = r"[\p{L}\p{N}]+"


def automaton(strings):
    """Finds all of ``strings`` (not empty); what it yields are (end, place in the list)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, s in enumerate(strings):
        out.add_word(s, i)
    out.make_automaton()
    return out


def blocks(terms: DataFrame, size: int = BLOCK) -> list[list[str]]:
    """Different strings (column ``term``), without nulls and empty ones, in lists of about ``size`` characters."""
    asked = terms.select(F.col("term").cast("string").alias("term")).filter("term <> ''").distinct()
    total = asked.agg(F.sum(F.char_length("term") + 8)).first()[0] or 0
    n = max(1, math.ceil(total / size))
    return [[r.term for r in asked.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == b).toLocalIterator()] for b in range(n)]


def occurrences(texts: DataFrame, terms: DataFrame, keep: list[str], parts: str = "parts", body: str | None = None, need_token: bool = False, size: int = BLOCK) -> DataFrame:
    """(keep, term, count, pages): which terms occur in which texts, how often (from left to right, without
    overlap), and on which pages, ascending by place. ``parts`` is an array of (page, text), whose texts together are
    what is searched, unless ``body`` names another column to count in. A page counts if a term lies in one of its
    parts. With ``need_token`` a term counts only where it shares a whole word with the text. Case is the caller's
    business. Null texts, and terms that are null or empty, have no occurrences."""
    source = texts.select(*keep, F.col(parts).alias("_parts"), (F.col(body) if body else F.lit(None).cast("string")).alias("_body"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    names = [*keep, "term", "count", "pages"]

    def searched(block: list[str]) -> DataFrame:
        held = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            import regex

            strings = held.value
            if not strings:
                return
            machine, width = automaton(strings), [len(s) for s in strings]
            words = [set(regex.findall(_TOKEN, s)) for s in strings] if need_token else None
            for batch in batches:
                rows, term, count, pages = [], [], [], []
                for i, (own, other) in enumerate(zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True)):
                    own = [(p["page"], p["text"] or "") for p in own or []]
                    whole = "".join(t for _, t in own)
                    where = places(machine, width, whole, own)
                    said = whole if other is None else other
                    times = counts(machine, width, said)
                    have = set(regex.findall(_TOKEN, said)) if need_token and times else None
                    for k, n in times.items():
                        if have is None or not have.isdisjoint(words[k]):
                            rows.append(i)
                            term.append(strings[k])
                            count.append(n)
                            pages.append(where.get(k, []))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows, pa.int64())) for c in range(len(keep))], pa.array(term, pa.string()), pa.array(count, pa.int64()), pa.array(pages, pa.list_(pa.int32()))], names)

        return source.mapInArrow(run, f"{kinds}, term string, count long, pages array<int>")

    return reduce(DataFrame.unionByName, [searched(b) for b in blocks(terms, size)])


def counts(machine, width: list[int], text: str) -> dict[int, int]:
    """Occurrences of each found string, from left to right, without overlap with itself."""
    free, out = {}, {}
    for end, k in machine.iter(text):
        if end - width[k] + 1 >= free.get(k, 0):
            free[k] = end + 1
            out[k] = out.get(k, 0) + 1
    return out


def places(machine, width: list[int], whole: str, parts: list) -> dict[int, list[int]]:
    """The numbered pages on which each string is found, in order, each once."""
    if not any(p is not None for p, _ in parts):
        return {}
    starts, at = [], 0
    for _, t in parts:
        starts.append(at)
        at += len(t)
    out: dict[int, list[int]] = {}
    for end, k in machine.iter(whole):
        i = bisect_right(starts, end - width[k] + 1) - 1
        page, text = parts[i]
        if page is not None and end < starts[i] + len(text):
            out.setdefault(k, {})[page] = True
    return {k: list(v) for k, v in out.items()}
