"""Word dictionaries used inside a row, so that texts never shuffle.

A dictionary is a language resource (valences, stop words, lemmas, tags, aspect keywords).
Its rows are collected once, size-checked, and become one literal: an array of small maps
indexed by the hash of the word. A lookup costs a hash and a short scan, whatever the size,
and no token is ever exploded or shuffled. A larger table is joined to the distinct words of the
texts, and each text gets the entries it needs as a map; the lookups give the same values.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.operators.bounded import join_dimension, rows_within

MAX_DICTIONARY_ROWS = 200_000
_ROWS_PER_BUCKET = 2
_MAX_IN_LIST = 1_000


class Dictionary:
    """Word -> value lookup. ``value_type`` is the Spark SQL type of a value."""

    def __init__(self, entries: dict[str, object], hashes: dict[str, int], value_type: str):
        self.entries = entries
        self.value_type = value_type
        size = max(1, len(entries) // _ROWS_PER_BUCKET)
        buckets: dict[int, list[str]] = defaultdict(list)
        for word in entries:
            buckets[hashes[word] % size].append(word)
        self._size = size
        # One JSON literal, which the optimizer folds into the array once: an expression per
        # entry would take longer to analyse than to run.
        self._json = json.dumps(
            [{word: entries[word] for word in buckets[bucket]} for bucket in range(size)]
        )

    def __len__(self) -> int:
        return len(self.entries)

    def value_of(self, word: Column) -> Column:
        """NULL for a word that is not listed."""
        if not self.entries:
            return F.lit(None).cast(self.value_type)
        slot = F.pmod(F.hash(word), F.lit(self._size))
        table = F.from_json(F.lit(self._json), f"array<map<string,{self.value_type}>>")
        return F.try_element_at(F.get(table, slot), word)

    def contains(self, word: Column) -> Column:
        if not self.entries:
            return F.lit(False)
        if len(self.entries) > _MAX_IN_LIST:
            return self.value_of(word).isNotNull()
        return word.isin(list(self.entries))


class RowDictionary:
    """Lookup in a map column that ``attach`` has put next to each text."""

    def __init__(self, table: DataFrame, name: str, value_type: str):
        self.table = table  # (w, v), one row per word
        self.name = name
        self.value_type = value_type

    def __len__(self) -> int:
        return MAX_DICTIONARY_ROWS

    def value_of(self, word: Column) -> Column:
        return F.try_element_at(F.col(self.name), word)

    def contains(self, word: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(self.name), word).isNotNull(), F.lit(False))

    def attach(self, texts: DataFrame, text: str, words: Column) -> DataFrame:
        """``texts`` with the entries of their own words as a map.

        Each distinct word of a text is joined once; the table is broadcast up to a checked size,
        beyond it a frequent word is salted (``join_dimension``). Equal texts share one entry.
        """
        key = F.md5(F.coalesce(F.col(text), F.lit("")))
        needed = texts.select(key.alias("_text"), F.explode(F.array_distinct(words)).alias("w")).distinct()
        found = join_dimension(needed, self.table, "w").groupBy("_text")
        found = found.agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias(self.name))
        return texts.withColumn("_text", key).join(found, "_text", "left").drop("_text")


def collect_dictionary(
    df: DataFrame,
    word: str,
    value: Column,
    value_type: str,
    many: bool = False,
    bound: int = MAX_DICTIONARY_ROWS,
    name: str = "_dictionary",
) -> Dictionary | RowDictionary:
    """Load a dictionary table. ``many`` keeps all values of a word as an array; otherwise the
    largest of several counts. A table of more than ``bound`` rows becomes a ``RowDictionary``,
    whose entries have to be attached to the texts as the column ``name``."""
    listed = df.filter(F.col(word) != "").select(
        F.col(word).alias("w"), value.alias("v"), F.hash(word).alias("h")
    )
    rows = rows_within(listed, bound)
    if rows is None:
        chosen = F.sort_array(F.collect_set("v")) if many else F.max("v")
        table = listed.filter(F.col("v").isNotNull()).groupBy("w").agg(chosen.alias("v"))
        return RowDictionary(table, name, f"array<{value_type}>" if many else value_type)
    hashes = {row.w: row.h for row in rows}
    grouped: dict[str, set] = defaultdict(set)
    for row in rows:
        if row.v is not None:
            grouped[row.w].add(row.v)
    if not many:
        return Dictionary({w: max(v) for w, v in grouped.items()}, hashes, value_type)
    return Dictionary({w: sorted(v) for w, v in grouped.items()}, hashes, f"array<{value_type}>")


def empty_dictionary(value_type: str) -> Dictionary:
    return Dictionary({}, {}, value_type)
