"""Which markers of a table occur in which texts, by one automaton over all markers and one pass over each text.

A trie of the markers with failure links reports every marker that ends at a place, also those inside others, so a text is
read once however many markers there are. Markers are a query set: they come to the driver in blocks of bounded size, each
of which is broadcast and passes over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the markers of one block; their automaton takes some hundred bytes each.
BLOCK_CHARS = 2_000_000
#: Pieces of texts that a worker remembers, and the longest of them.
PIECES, LONGEST = 300_000, 64


class Automaton:
    """Broadcast as a list; each worker builds the trie once."""

    def __init__(self, markers: list[tuple[int, str]]):
        self.markers = markers

    def __getstate__(self) -> dict:
        return {"markers": self.markers}

    @cached_property
    def trie(self) -> ahocorasick.Automaton:
        trie = ahocorasick.Automaton()
        for i, marker in enumerate(self.ids):
            trie.add_word(marker, i)
        trie.make_automaton()
        return trie

    @cached_property
    def numbers(self) -> list[list[int]]:
        return list(self.ids.values())

    @cached_property
    def ids(self) -> dict[str, list[int]]:
        ids: dict[str, list[int]] = {}
        for number, marker in self.markers:
            ids.setdefault(marker, []).append(number)
        return ids

    @cached_property
    def pieces(self):
        """Cuts a text at the characters that no marker has: no occurrence lies across them."""
        return re.compile("[" + "".join(map(re.escape, sorted({c for marker in self.ids for c in marker}))) + "]+").findall

    @cached_property
    def known(self) -> Known:
        return Known(self.trie)

    def found(self, text: str | None) -> list[int]:
        if not text or not self.markers:
            return []
        hits = set().union(*map(self.known.__getitem__, set(self.pieces(text))))
        return sorted(number for hit in hits for number in self.numbers[hit])


class Known(dict):
    """Piece of a text: the markers in it. Short pieces are remembered, up to a bound."""

    def __init__(self, trie: ahocorasick.Automaton):
        super().__init__()
        self.trie = trie

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = tuple({hit for _, hit in self.trie.iter(piece)})
        if len(piece) <= LONGEST and len(self) < PIECES:
            self[piece] = found
        return found


def blocks_of(markers: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    held = 0
    for number, marker in markers.toLocalIterator():
        if block and held + len(marker) > most:
            yield block
            block, held = [], 0
        block.append((number, marker))
        held += len(marker)
    yield block


def match_markers(rows: DataFrame, markers: DataFrame, row_id: str, text: Column, marker_id: str = "marker_id", marker: str = "marker", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """row_id and `found`, the sorted ids (long) of the markers that its text holds; a row for each row and block of markers
    that has a hit in it, and for each row in the first block.

    Null and empty markers occur nowhere, null texts hold nothing; markers that are equal are all found; overlapping ones too.
    """
    asked = markers.select(F.col(marker_id).cast("long"), marker).where(F.col(marker_id).isNotNull() & (F.col(marker) != ""))
    chosen = rows.select(row_id, text.alias("__text"))
    schema = f"{row_id} {rows.schema[row_id].dataType.simpleString()}, found array<bigint>"
    parts = []
    for block in blocks_of(asked, block_chars):
        shared = rows.sparkSession.sparkContext.broadcast(Automaton(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=not parts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pa.array([shared.value.found(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))
                out = pa.RecordBatch.from_arrays([batch.column(0), found], [row_id, "found"])
                yield out if first else out.filter(pa.compute.greater(pa.compute.list_value_length(found), 0))

        parts.append(chosen.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)
