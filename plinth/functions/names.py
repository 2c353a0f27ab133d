"""Many names at once: an automaton over all of them, sent to the tasks, that reads each text once however many names there are."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plinth.functions.text import words

#: Lengths of names that count, and characters of all names at most: an automaton takes some 100 bytes a character in each task.
SHORTEST, LONGEST, MOST = 2, 20, 2_000_000


def automaton(names: list[str]):
    """An automaton of the names in lower case; None if none has a length that counts."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for n in {n.lower() for n in names if n and SHORTEST <= len(n) <= LONGEST}:
        found.add_word(n)
    if not len(found):
        return None
    found.make_automaton()
    return found


def spans(found, text: str) -> list[tuple[int, int]]:
    """Start and end of names in a text: from the left, of those that begin at a place the longest, none over another."""
    best: dict[int, int] = {}
    for last, length in found.iter(text):
        start = last + 1 - length
        if best.get(start, 0) < last + 1:
            best[start] = last + 1
    out, at = [], 0
    for start in sorted(best):
        if start >= at:
            out.append((start, best[start]))
            at = best[start]
    return out


def splitter(spark: SparkSession, names: list[str], flank: bool = False) -> Callable[[Column], Column]:
    """A function of a text column to a struct: names (in lower case, as they stand in the text) and rest (the text without them; a null text has a null rest). flank: a
    name that begins or ends in a letter or digit of ASCII counts only if none stands next to it."""
    if sum(map(len, names)) > MOST:
        raise ValueError(f"more than {MOST} characters of names: join them as rows instead")
    sent = spark.sparkContext.broadcast(sorted({n.lower() for n in names if n}))

    @F.pandas_udf("struct<names: array<string>, rest: string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(sent.value)
        alone = re.compile("[0-9a-z]")
        for texts in batches:
            rows = []
            for t in texts:
                if t is None or found is None:
                    rows.append(([], t))
                    continue
                t = t.lower()
                at = spans(found, t)
                if flank:
                    at = [(a, b) for a, b in at if not (alone.match(t[a]) and a and alone.match(t[a - 1])) and not (alone.match(t[b - 1]) and b < len(t) and alone.match(t[b]))]
                rest, last = [], 0
                for a, b in at:
                    rest.append(t[last:a])
                    last = b
                rows.append(([t[a:b] for a, b in at], " ".join([*rest, t[last:]])))
            yield pd.DataFrame(rows, columns=["names", "rest"])

    return split


def named_words(spark: SparkSession, names: list[str], flank: bool = False) -> Callable[[Column], Column]:
    """A function of a text column to its words with the names whole: names first, then the words of the rest (see text.words). Null texts have no words."""
    split = splitter(spark, names, flank)

    def tokens(text: Column) -> Column:
        parts = split(text)
        return F.concat(parts["names"], F.coalesce(words(parts["rest"]), F.array().cast("array<string>")))

    return tokens
