"""Byte-level BPE by one dynamic program over the prefixes of a word, and decoding.

A prefix of a word has exactly one encoding, so exactly one last token. An automaton over the vocabulary's bytes gives
the tokens that are suffixes of each prefix; of these the last one is the token that is whole (it encodes to itself) and
is compatible with the last token of the prefix before it. Following the stored tokens back from the end gives the ids
that merging by rank gives, in one pass over the word whatever its length.

Two neighbours are compatible if merging never crosses the border between them: both grow towards it along their own
merges, in order of rank, and no merge of the two parts at the border may come first (of equal ranks the left one does).

The vocabulary is read by the driver and broadcast; a file has some ten thousand tokens, whatever the corpus. Words that
recur are looked up: a task remembers at most WORDS of them, each of at most LONGEST characters, and forgets no result.

Defined results: a null text counts as empty and has no tokens; added tokens are found wherever their strings occur, the
leftmost and longest first; repeated rows each get their own result; ids outside the vocabulary, and null ids, decode to
nothing; a null list decodes to an empty text; bytes that are no UTF-8 decode to U+FFFD. Columns named like the output
are replaced, all others stay.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpworks.llm.shared import table

#: Letters and numbers that Unicode 16.0 added to 15.1, which is what this Python's tables hold.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: White space of Unicode.
SPACES = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: English endings that are words of their own.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Words that a Python worker remembers, and the longest of them.
WORDS, LONGEST = 800_000, 64
#: Pairs of tokens whose test a Python worker remembers.
PAIRS = 1_000_000
#: Rows that are encoded at once.
ROWS = 200
NEVER = 1 << 60


def _ranges(kind: str, more: list[tuple[int, int]], below: int) -> str:
    """Code points under `below` whose category starts with kind, as the inside of a character class."""
    found: list[list[int]] = []
    for c in sorted({c for c in range(below) if unicodedata.category(chr(c))[0] == kind} | {c for a, b in more for c in range(a, b + 1) if c < below}):
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


def word_patterns() -> list[str]:
    """Words of the byte-level scheme: endings, or runs of letters, numbers or others with a space before them, or white space.

    Three patterns that agree on their own texts: for those of ASCII, of the basic plane, and all. The classes of the last
    one have some hundred ranges, through which a search goes one by one; those of the others are looked up.
    """
    out = []
    for below in (0x80, 0x10000, 0x110000):
        letter, number = _ranges("L", NEW_LETTERS, below), _ranges("N", NEW_NUMBERS, below)
        out.append(f"{ENDINGS}| ?[{letter}]+| ?[{number}]+| ?[^{SPACES}{letter}{number}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
    return out


def byte_letters() -> dict[str, int]:
    """Which byte each character of a token stands for: visible Latin-1 characters are themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and added tokens of a tokenizer file; what encoding needs is built where it is first used."""

    def __init__(self, pieces: dict[int, bytes], merges: list[tuple[int, int, int]], added: dict[str, int], patterns: list[str]):
        self.pieces, self.merges, self.added, self.patterns = pieces, merges, added, patterns

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a tokenizers JSON file with a byte-level BPE model; ValueError if it asks for what is not built here."""
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        model, before, letters = file["model"], file["pre_tokenizer"] or {}, byte_letters()
        plain = file.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or not plain or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        of, ids = lambda token: bytes(letters[c] for c in token), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        pieces = {i: of(t) for t, i in ids.items() if t not in added} | {i: t.encode() for t, i in added.items()}
        return cls(pieces, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], added, word_patterns())

    @cached_property
    def table(self) -> list[bytes]:
        return [self.pieces.get(i, b"") for i in range(max(self.pieces) + 1)]

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("pieces", "merges", "added", "patterns")}


class Encoder(dict):
    """Word: its ids, as the bytes of an int32 array. A word that is asked for the first time is encoded."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(v.merges)}
        made = {t: (a, b, r) for r, (a, b, t) in enumerate(v.merges)}
        single = {t for t, piece in v.pieces.items() if len(piece) == 1 and t not in made}
        if len({v.pieces[t] for t in single}) < 256 or len(made) < len(v.merges):
            raise ValueError("a byte has no token, or a token comes from two merges")
        #: What a token's first and last parts were, from one byte on, each with the rank that made it.
        self.left, self.right = {t: [(t, -1)] for t in single}, {t: [(t, -1)] for t in single}
        for t, (a, b, r) in made.items():  # parts come before what is made of them
            self.left[t], self.right[t] = [*self.left[a], (t, r)], [*self.right[b], (t, r)]
        self.known: dict[int, bool] = {}
        whole = {t for t in single}
        for t, (a, b, r) in made.items():
            if a in whole and b in whole and self.compatible(a, b, r):
                whole.add(t)
        self.ids = {v.pieces[t]: t for t in whole}
        self.automaton = ahocorasick.Automaton()
        for piece, t in self.ids.items():
            self.automaton.add_word(piece.decode("latin-1"), t << 16 | len(piece))
        self.automaton.make_automaton()
        self.ascii, self.basic, self.all = (re.compile(p).findall for p in v.patterns)
        self.added = v.added
        self.cut = re.compile("|".join(map(re.escape, sorted(v.added, key=len, reverse=True)))) if v.added else None

    def compatible(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge below rank `before` crosses the border between a and b."""
        left, right, i, j = self.right[a], self.left[b], 0, 0
        while True:
            next_left = left[i + 1][1] if i + 1 < len(left) else NEVER
            next_right = right[j + 1][1] if j + 1 < len(right) else NEVER
            across = self.rank.get((left[i][0], right[j][0]), NEVER)
            if across < before and across < next_left and across <= next_right:
                return False
            if next_left == next_right == NEVER:
                return True
            i, j = (i + 1, j) if next_left <= next_right else (i, j + 1)

    def ids_of(self, word: bytes) -> tuple[int, ...]:
        """The word's ids by the last tokens of its prefixes."""
        if (own := self.ids.get(word)) is not None:
            return (own,)
        last, known, done = [-1] * (len(word) + 1), self.known, 0
        if len(known) > PAIRS:
            known.clear()
        for at, match in self.automaton.iter(word.decode("latin-1")):
            if at < done:  # this prefix has its token
                continue
            if start := at + 1 - (match & 0xFFFF):
                pair = last[start] >> 16 << 32 | match >> 16
                if (fits := known.get(pair)) is None:
                    fits = known[pair] = self.compatible(pair >> 32, match >> 16)
                if not fits:
                    continue
            done = at + 1
            last[done] = match
        found, at = [], len(word)
        while at:
            found.append(last[at] >> 16)
            at -= last[at] & 0xFFFF
        return tuple(reversed(found))

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.ids_of(word.encode()), np.int32).tobytes()
        if len(word) <= LONGEST and len(self) < WORDS:
            self[word] = found
        return found

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        return self.basic(text) if len(text.encode("utf-16-le")) == 2 * len(text) else self.all(text)

    def encode(self, text: str) -> np.ndarray:
        found, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            found.extend(map(self.__getitem__, self.words(text[at : m.start()])))
            found.append(np.int32(self.added[m.group()]).tobytes())
            at = m.end()
        found.extend(map(self.__getitem__, self.words(text[at:] if at else text)))
        return np.frombuffer(b"".join(found), np.int32)


def _with_column(docs: DataFrame, source: str, name: str, kind: T.DataType, of: Callable[[pa.Array], pa.Array], keep: bool) -> DataFrame:
    """docs with a column made from `source` by batches; without the source's own column unless keep (or it has the name)."""
    names = [c for c in docs.columns if c not in (name, "" if keep else source)]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), of(batch.column(len(names)))], [*names, name])

    made = "__made_from"
    return docs.select(*names, F.col(source).alias(made)).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """docs with the token ids of each whole text, an array of int."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def of(texts: pa.Array) -> pa.Array:
        encoder, found, ends = shared.value.encoder, [], [0]
        for t in texts:
            found.append(encoder.encode(t.as_py() or ""))
            ends.append(ends[-1] + len(found[-1]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))

    return _with_column(docs, text, ids, T.ArrayType(T.IntegerType()), of, keep_text)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """docs with the text that each list of ids stands for, added tokens included."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def of(lists: pa.Array) -> pa.Array:
        pieces = shared.value.table
        ends = lists.offsets.to_numpy()
        own = lists.values.slice(ends[0], ends[-1] - ends[0])  # a slice's values are those of its whole batch
        flat, ends = own.to_pylist(), (ends - ends[0]).tolist()
        if own.null_count or flat and not 0 <= min(flat) <= max(flat) < len(pieces):
            piece = lambda i: pieces[i] if i is not None and 0 <= i < len(pieces) else b""
        else:
            piece = pieces.__getitem__
        return pa.array([b"".join(map(piece, flat[a:b])).decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string())

    whole = docs.withColumn(ids, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")))
    return _with_column(whole, ids, text, T.StringType(), of, keep_ids)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents, and the text that they decode to, as digests."""
    import public_tokenizers

    vocabulary = Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    there = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, keep_text=False)
    back = decode(there, vocabulary, text="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
