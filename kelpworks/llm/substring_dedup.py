"""Substring dedup by collinear chaining: shared seeds, chains with gap costs through a Fenwick tree, alignment.

1. Seeds: word k-mers of two sizes. LONG ones are minimizers: two texts that share MIN_WORDS words share one. SHORT ones
   are chosen by their own hash, so that two texts choose the same ones whatever stands around; they find passages with
   changed words. All places of a seed count, save those within MIN_WORDS of its last one in the same text.
2. Links: equal texts are one node, its smallest id. Each seed that several nodes hold is linked from all of them to the
   smallest one, and from each place to the one before it in the same text, so links grow with the occurrences and not
   with their square.
3. What the smallest holder leaves open: where no passage with it covers a holder's seed, all holders of that seed are
   linked again by narrower keys, each again to its smallest holder. Around LONG seeds these are all stretches of
   MIN_WORDS words that contain the seed, so that texts with such a stretch in common are compared with one that has it.
   Around SHORT ones they are the seed together with a NEAR-mer close to it, of which one in NEAR_EVERY is chosen by hash.
4. Chains: the matches of two nodes are chained in order of both texts; a gap costs GAP a word on either side. The
   best predecessor is a prefix maximum over the other text's positions, kept in a Fenwick tree.
5. Alignment: hashed words around a chain are fetched in blocks; between matches and beyond the ends words are compared.
   A passage counts if it has MIN_WORDS words on both sides and SIMILAR of them match.

Result: one row per passage found in a node and the one it is linked to (the same one where a text repeats a passage
within itself), and one per copy of a node. A document without a repeated passage has no row. Positions are those of
words (from 0, end exclusive).

Defined results: a null text, and one of under MIN_WORDS words, has no passage; ids are whole numbers, and rows with a
null id take no part; repeated rows count as one; of rows of one id with different texts the one whose text has the
smallest hash stands for the id; within one text, places that overlap, or that are a run of one period (of at most half
their length), are no repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.llm.near_dedup import FOLD, mix
from kelpworks.llm.shared import BROADCAST_KEYS, only_or_without, stored, table

MIN_WORDS, SIMILAR, GAP = 50, 0.8, 0.1
#: k-mer size, and minimizer window: 24 + 27 - 1 = 50 words in common give a long seed.
LONG = (24, 27, True)
#: k-mer size, and of how many k-mers one is chosen by its hash.
SHORT = (7, 6, False)
#: Size of the k-mers that narrow a SHORT seed, of how many one is chosen, and how many words from the seed they may start.
NEAR, NEAR_EVERY, NEAR_WORDS = 5, 4, 50
#: Share of matches from which level words need no other alignment, cells of an alignment's table, and words of a step beyond the ends.
LEVEL, CELLS, EDGE = 0.5, 65_536, 24
#: Words of a block, and of the margin around a chain that is looked at.
BLOCK, MARGIN = 64, 96
POWER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(POWER), -1, 2**64))


def hashes_of(text: bytes | None) -> np.ndarray:
    words = text.translate(FOLD).split() if text else []
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def _powers(n: int, kept: list = [np.cumprod(np.full(4096, POWER)), np.cumprod(np.full(4096, INVERSE))]) -> list[np.ndarray]:  # noqa: B006
    """The first n powers of POWER and of its inverse; kept for further texts."""
    if len(kept[0]) < n:
        kept[:] = [np.cumprod(np.full(2 * n, x)) for x in (POWER, INVERSE)]
    return [x[:n] for x in kept]


def kmers_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers of words."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    up, down = _powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    return mix((sums[k:] - sums[:-k]) * down[:n] ^ np.uint64(k))


def _running(x: np.ndarray, w: int, of: np.ufunc) -> np.ndarray:
    """The least or largest of each w neighbours, in steps that double."""
    size = 1
    while size * 2 <= w:
        x, size = of(x[:-size], x[size:]), size * 2
    return of(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def seeds_of(h: np.ndarray, k: int, w: int, minimal: bool, apart: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions of the seeds of k words, and where each had its place before (-1: none).

    Seeds are the minimizers within w k-mers, or those of which the hash is a multiple of w. Places of a seed less
    than `apart` words after its last one are left out: they are looked at with that.
    """
    kmers = kmers_of(h, k)
    if not minimal:
        at = np.flatnonzero(kmers % np.uint64(w) == 0)
    elif len(kmers) <= w:
        at = np.array([int(kmers.argmin())] if len(kmers) else [], np.int64)
    else:
        edge = np.zeros(w - 1, np.uint64)  # a k-mer is the least of some window if the largest minimum of its windows is its own
        at = np.flatnonzero(_running(np.concatenate([edge, _running(kmers, w, np.minimum), edge]), w, np.maximum) == kmers)
    values = kmers[at]
    order = np.argsort(values, kind="stable")  # places of a seed stay in order
    values, at = values[order], at[order]
    was = np.full(len(at), -1, np.int64)
    again = np.flatnonzero(values[1:] == values[:-1]) + 1
    kept = np.ones(len(at), bool)
    last = {}
    for i, v, here, there in zip(again.tolist(), values[again].tolist(), at[again].tolist(), at[again - 1].tolist(), strict=True):
        before = last.setdefault(v, there)
        if here - before < apart:
            kept[i] = False
        else:
            was[i], last[v] = before, here
    return values[kept], at[kept], was[kept]


def narrower(h: np.ndarray, seed: np.ndarray, at: np.ndarray, k: np.ndarray, hub: np.ndarray, open_: np.ndarray, whole: int = MIN_WORDS) -> list[np.ndarray]:
    """Columns of narrower keys around a text's seeds: key, place, k, and whether a seed that it comes from is open."""
    long, small = kmers_of(h, whole), kmers_of(h, NEAR)
    # stretches of `whole` words that contain a LONG seed
    wanted, opened = np.zeros(len(long), bool), np.zeros(len(long), bool)
    for of, chosen in ((wanted, k == LONG[0]), (opened, (k == LONG[0]) & open_)):
        x = (at[chosen][:, None] - np.arange(whole - LONG[0] + 1)).ravel()
        of[x[(x >= 0) & (x < len(long))]] = True
    x = np.flatnonzero(wanted)
    # SHORT seeds, each with the chosen NEAR-mers around it; the hub is compared with every holder already
    near = np.flatnonzero(small % np.uint64(NEAR_EVERY) == 0)
    s = np.flatnonzero((k == SHORT[0]) & ~hub)
    begin, end = np.searchsorted(near, at[s] - NEAR_WORDS), np.searchsorted(near, at[s] + SHORT[0] + NEAR_WORDS)
    of = np.repeat(s, end - begin)
    place = near[np.arange(len(of)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)]
    outside = (place < at[of]) | (place > at[of] + SHORT[0] - NEAR)
    of, place = of[outside], place[outside]
    keys = np.concatenate([long[x], mix(small[place] * POWER ^ seed[of].view(np.uint64))]).view(np.int64)
    return [keys, np.concatenate([x, at[of]]), np.concatenate([np.full(len(x), whole), k[of]]), np.concatenate([opened[x], open_[of]])]


def chains_of(i: np.ndarray, j: np.ndarray, k: np.ndarray, gap: float = GAP) -> list[np.ndarray]:
    """Indices of the matches of each chain, best first. A match is k words from i in one text and from j in the other."""
    order = np.lexsort((j, i))
    places = np.unique(j)
    rank = np.searchsorted(places, j) + 1
    size = len(places)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)  # of prefix maxima of score + gap * (i + j)
    score, before = np.zeros(len(i)), np.full(len(i), -1)
    waiting: list[int] = []
    last = None
    for m in order.tolist():
        if i[m] != last:  # matches that start at one place can't follow each other
            for x in waiting:
                value, r = (score[x] + gap * float(i[x] + j[x]), x), int(rank[x])
                while r <= size:
                    tree[r] = max(tree[r], value)
                    r += r & -r
            waiting, last = [], i[m]
        best, r = (-1e18, -1), int(rank[m]) - 1
        while r > 0:
            best = max(best, tree[r])
            r -= r & -r
        own, p = float(k[m]), best[1]
        if p >= 0:
            own = min(own, float(i[m] - i[p]), float(j[m] - j[p]))  # overlapping matches count their new words
            linked = best[0] - gap * float(i[m] + j[m]) + own
            if linked > k[m]:
                score[m], before[m] = linked, p
                waiting.append(m)
                continue
        score[m] = float(k[m])
        waiting.append(m)
    used = np.zeros(len(i), bool)
    chains = []
    for m in np.argsort(-score, kind="stable").tolist():
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = int(before[m])
        if chain:
            chains.append(np.array(chain[::-1]))
    return chains


def matched_in(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a longest common subsequence of two short stretches, by dynamic programming over shared words.

    A row of the table is one number: its bit j is 0 where the length grows at the jth word of v.
    """
    u, v = u.tolist(), v.tolist()
    shared = set(u) & set(v)
    own, other = ([n for n, w in enumerate(x) if w in shared] for x in (u, v))
    u, v = [u[n] for n in own], [v[n] for n in other]
    places = dict.fromkeys(shared, 0)
    for n, w in enumerate(v):
        places[w] |= 1 << n
    full = (1 << len(v)) - 1
    rows = [full]
    for w in u:
        row = rows[-1]
        same = row & places[w]
        rows.append(((row + same) | (row - same)) & full)
    i, j, at, to = len(u), len(v), [], []
    while i and j:
        if u[i - 1] == v[j - 1]:
            i, j = i - 1, j - 1
            at.append(own[i])
            to.append(other[j])
        elif (rows[i - 1] & (low := (1 << j) - 1)).bit_count() == (rows[i] & low).bit_count():
            i -= 1  # as long without the word of u
        else:
            j -= 1
    return np.array(at[::-1], np.int64), np.array(to[::-1], np.int64)


def aligned(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of the alignment along a chain: positions in a and b, and whether the words match (0 matches nothing).

    Between seeds, words that lie level are compared in place; where one side has more words, or few of them match, the best
    common subsequence decides, so that any number of inserted and deleted words is followed. Beyond the ends it does too, in
    steps of EDGE words, as long as most of a step matches.
    """
    parts: list[list[int]] = []  # where a run of columns begins in a and b, its length, and whether each side goes along

    def beside(x: int, y: int, n: int) -> None:
        if n > 0:
            if parts and (last := parts[-1])[3] and last[4] and last[0] + last[2] == x and last[1] + last[2] == y:
                last[2] += n
            else:
                parts.append([x, y, n, 1, 1])

    def surplus(x: int, y: int, n: int, in_a: bool) -> None:
        if n > 0:
            parts.append([x, y, n, int(in_a), int(not in_a)])

    def between(x: int, y: int, until_x: int, until_y: int) -> None:
        """Columns of two stretches, none of which is a seed."""
        n, m = until_x - x, until_y - y
        if n == m and (n < 3 or np.count_nonzero(a[x:until_x] == b[y:until_y]) >= LEVEL * n):
            return beside(x, y, n)
        if n * m > CELLS:  # too long for one table: the surplus stands after what matches from the left
            head = min(n, m)
            same = a[x : x + head] == b[y : y + head]
            head = head if same.all() else int(same.argmin())
            beside(x, y, head)
            surplus(x + head, y + head, abs(n - m), n > m)
            return beside(until_x - (min(n, m) - head), until_y - (min(n, m) - head), min(n, m) - head)
        at, to = matched_in(a[x:until_x], b[y:until_y])
        for p, q in [*zip((at + x).tolist(), (to + y).tolist(), strict=True), (until_x, until_y)]:
            level = min(p - x, q - y)
            beside(x, y, level)
            surplus(x + level, y + level, max(p - x, q - y) - level, p - x > q - y)
            if p < until_x or q < until_y:
                beside(p, q, 1)
            x, y = p + 1, q + 1

    def edge(u: np.ndarray, v: np.ndarray) -> tuple[int, int]:
        """How many words of both sides to follow from an end: up to the last match of a step that matches for the most part."""
        n = m = 0
        while len(own := u[n : n + EDGE]) and len(other := v[m : m + EDGE]):
            level = min(len(own), len(other))
            if np.count_nonzero(own[:level] == other[:level]) >= LEVEL * level:
                step = level, level
            elif len((x := set(own.tolist())) & (y := set(other.tolist()))) < LEVEL * min(level, len(x), len(y)):
                break  # too few words in common, whatever their order
            else:
                at, to = matched_in(own, other)
                if len(at) < LEVEL * level:
                    break
                step = int(at[-1]) + 1, int(to[-1]) + 1
            n, m = n + step[0], m + step[1]
        return n, m

    first = int(i[0]), int(j[0])
    n, m = edge(a[: first[0]][::-1], b[: first[1]][::-1])
    more = min(first[0] - n, first[1] - m)
    beside(first[0] - n - more, first[1] - m - more, more)
    between(first[0] - n, first[1] - m, *first)
    ia, jb = first
    for x, y, size in zip(i.tolist(), j.tolist(), k.tolist(), strict=True):
        skip = max(0, ia - x, jb - y)  # what is aligned already
        if skip >= size:
            continue
        x, y, size = x + skip, y + skip, size - skip
        between(ia, jb, x, y)
        beside(x, y, size)
        ia, jb = x + size, y + size
    n, m = edge(a[ia:], b[jb:])
    between(ia, jb, ia + n, jb + m)
    beside(ia + n, jb + m, min(len(a) - ia - n, len(b) - jb - m))
    x, y, size, in_a, in_b = np.array(parts).T
    along = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    p, q = (np.repeat(start, size) + along * np.repeat(goes, size) for start, goes in ((x, in_a), (y, in_b)))
    both = np.repeat((in_a & in_b).astype(bool), size)
    u = a[np.minimum(p, len(a) - 1)]
    return p, q, both & (u == b[np.minimum(q, len(b) - 1)]) & (u != 0)


def periodic(words: np.ndarray, similar: float) -> bool:
    """Whether the words repeat after at most half their length."""
    return any((words[p:] == words[:-p]).mean() >= similar for p in range(1, len(words) // 2 + 1))


def passages_of(left: np.ndarray, right: np.ndarray, same: np.ndarray, least: int, similar: float) -> list[tuple[int, int]]:
    """Disjoint stretches of columns with at least so many words on both sides and that share of matches, which begin and end
    with two matches (one may be chance); each the best of what is left, by matches against misses. A stretch that is best
    alone but too short does not hide a longer one around it."""
    gain = np.where(same, 1.0, -similar / (1 - similar))
    found, todo = [], [(0, len(same))]
    while todo:
        low, high = todo.pop()
        if np.count_nonzero(same[low:high]) < similar * least:
            continue
        l, r, own = left[low:high], right[low:high], same[low:high]
        opens, closes = own.copy(), own.copy()
        opens[:-1] &= own[1:]
        closes[1:] &= own[:-1]
        opens[-1] = closes[0] = False
        sums = np.concatenate([np.zeros(1), np.cumsum(gain[low:high])])
        # the last column at which a stretch may begin that ends with each column, so that both sides have enough words
        until = np.minimum(np.searchsorted(l, l + 1 - least, "right"), np.searchsorted(r, r + 1 - least, "right")) - 1
        begins = np.where(opens, sums[:-1], np.inf)
        lowest = np.minimum.accumulate(begins)
        value = np.where(closes & (until >= 0), sums[1:] - lowest[np.maximum(until, 0)], -np.inf)
        end = int(value.argmax())
        if value[end] < -1e-9:
            continue
        start = int(np.flatnonzero(begins[: until[end] + 1] == lowest[until[end]])[-1])
        found.append((low + start, low + end + 1))
        todo += [(low, low + start), (low + end + 1, high)]
    return found


def _rows(docs: DataFrame, of, schema: str) -> DataFrame:
    """Rows that `of` makes from an id and a text, as columns; docs: id, text."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                parts = [of(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)]
                parts = [p for p in parts if p is not None and len(p[0])]
                if parts:
                    columns = [sum((p[c] for p in parts), []) if isinstance(parts[0][c], list) else np.concatenate([p[c] for p in parts]) for c in range(len(names))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(run, schema)


def _structs(lists: pa.ListArray, *names: str) -> tuple[list[int], list[np.ndarray]]:
    """Where each list of structs begins and ends, and fields of all of them."""
    return lists.offsets.to_pylist(), [lists.values.field(c).to_numpy().astype(np.int64) for c in names]


def find_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, similar: float = SIMILAR) -> DataFrame:
    """doc_id, other_id (the smaller one), start, end, other_start, other_end, matched, copy (true: the texts are equal)."""
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    named = [F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), F.length("text").alias("n")]
    several = base.select("id", *named).groupBy("id", "h1", "h2", "n").agg(F.count("*").alias("rows")).groupBy("id").agg(F.count("*").alias("texts"), F.sum("rows").alias("rows"), F.min(F.struct("h1", "h2", "n")).alias("first"))
    several = stored(several.where("rows > 1").select("id", "first", "texts"), "repeated-ids")
    repeated = not several.isEmpty()
    twice = several.where("texts > 1").select("id", "first")
    if repeated and not twice.isEmpty():
        side = F.broadcast(twice) if twice.count() <= BROADCAST_KEYS else twice
        base = base.join(side, "id", "left").where(F.col("first").isNull() | (F.col("first") == F.struct(*named))).drop("first")
    copies = base.select("id", *named).groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("most"))
    copies = stored(copies.where("rep != most"), "copied-texts")
    side = F.broadcast(copies) if copies.count() <= BROADCAST_KEYS else copies
    known = base.select("id", "text", *named).join(side, ["h1", "h2", "n"], "left")
    nodes = known.where("rep is null or rep = id").select("id", "text")

    def seeds(i: int, t: bytes) -> tuple | None:
        h = hashes_of(t)
        if len(h) < min_words:
            return None
        parts = [(*seeds_of(h, *size, apart=min_words), size[0]) for size in (LONG, SHORT)]
        value = np.concatenate([p[0] for p in parts]).view(np.int64)
        ints = (np.concatenate([np.broadcast_to(p[c], len(p[0])) for p in parts]).astype(np.int32) for c in (1, 2, 3))
        return value, np.full(len(value), i), *ints

    placed = stored(_rows(nodes, seeds, "seed long, id long, at int, was int, k int"), "seeds")
    held = placed.groupBy("seed").agg(F.count("*").alias("n"), F.min("id").alias("other")).where("n > 1").drop("n")
    shared = stored(placed.join(held.hint("shuffle_hash"), "seed"), "shared-seeds")
    first = stored(shared.where("id = other").groupBy("seed").agg(F.min("at").alias("there")), "first-seeds")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], [], [], []
            ids, others = (batch.column(c).to_pylist() for c in (0, 1))
            ends, (at, there, size) = _structs(batch.column(2), "at", "there", "k")
            for i, other, begin, end in zip(ids, others, ends, ends[1:], strict=False):
                a, b, k = (x[begin:end] for x in (at, there, size))
                for n, c in enumerate(chains_of(a, b, k)):
                    for column, x in zip(out, (i, other, n, a[c], b[c], k[c]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 3), strict=True)], ["id", "other", "chain", "i", "j", "k"])

    def blocks(i: int, t: bytes) -> tuple:
        h = (hashes_of(t) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        h[h == 0] = 1
        cuts = range(0, len(h), BLOCK)
        return np.full(len(cuts), i), np.arange(len(cuts), dtype=np.int32), [h[c : c + BLOCK].tobytes() for c in cuts]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "other_id", "start", "end", "other_start", "other_end", "matched"]
        for batch in batches:
            out = []
            ids, others = (batch.column(c).to_pylist() for c in (0, 1))
            places = [(x.offsets.to_pylist(), x.values.to_numpy().astype(np.int64)) for x in (batch.column(c) for c in (2, 3, 4))]
            ends, (side, block) = _structs(batch.column(5), "side", "block")
            words = batch.column(5).values.field("words").to_pylist()
            for n, (id_, other) in enumerate(zip(ids, others, strict=True)):
                own, k = slice(ends[n], ends[n + 1]), places[2][1][places[2][0][n] : places[2][0][n + 1]]
                sides = []
                for s, (bounds, values) in enumerate(places[:2]):
                    at = np.flatnonzero(side[own] == s) + own.start
                    at = at[np.argsort(block[at])]
                    begin = int(block[at[0]]) * BLOCK
                    sides.append((begin, np.frombuffer(b"".join([words[x] for x in at.tolist()]), np.int32), values[bounds[n] : bounds[n + 1]] - begin))
                (p, a, i), (q, b, j) = sides
                left, right, same = aligned(a, b, i, j, k)
                for x, y in passages_of(left, right, same, min_words, similar):
                    s, e, t, u = (int(c) for c in (left[x], left[y - 1] + 1, right[x], right[y - 1] + 1))
                    if min(e - s, u - t) >= min_words and (id_ != other or (q + u <= p + s and not periodic(a[s:e], similar))):
                        out.append((id_, other, p + s, p + e, q + t, q + u, int(same[x:y].sum())))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64() if c < 2 else pa.int32()) for c in range(7)], names)

    def compared(links: DataFrame) -> DataFrame:
        """Stored passages of linked nodes; links: id, other, at, there, k."""
        matches = links.groupBy("id", "other").agg(F.collect_list(F.struct("at", "there", "k")).alias("m"))
        chains = stored(matches.mapInArrow(chain, "id long, other long, chain int, i array<int>, j array<int>, k array<int>"), "chains")
        low = lambda c: F.greatest(F.floor((F.get(c, F.lit(0)) - MARGIN) / BLOCK), F.lit(0)).cast("int")
        high = lambda c: F.floor((F.element_at(c, -1) + F.element_at("k", -1) + MARGIN) / BLOCK).cast("int")
        wanted = lambda own, c, side: chains.select(F.col(own).alias("node"), F.explode(F.sequence(low(c), high(c))).alias("block"), "id", "other", "chain", F.lit(side).alias("side"))
        asked = wanted("id", "i", 0).unionByName(wanted("other", "j", 1))
        used = stored(chains.select(F.explode(F.array("id", "other")).alias("id")).distinct(), "chained")
        fetched = _rows(only_or_without(nodes, used, "left_semi", ["id"]), blocks, "node long, block int, words binary")
        fetched = stored(fetched.dropDuplicates(["node", "block"]) if repeated else fetched, "blocks")
        got = asked.join(fetched, ["node", "block"]).groupBy("id", "other", "chain").agg(F.collect_list(F.struct("side", "block", "words")).alias("got"))
        rows = chains.join(got, ["id", "other", "chain"]).select("id", "other", "i", "j", "k", "got").mapInArrow(align, "doc_id long, other_id long, start int, end int, other_start int, other_end int, matched int")
        return stored(rows.distinct(), "passages")

    links = shared.where("id != other").join(first, "seed").select("seed", "id", "other", "at", "there", "k")
    within = shared.where("was >= 0").select("id", F.col("id").alias("other"), "at", F.col("was").alias("there"), "k")
    found = compared(links.drop("seed").unionByName(within))

    # seeds of which a holder has no passage with the smallest one there
    covers = found.where("doc_id != other_id").select(F.col("doc_id").alias("id"), F.col("other_id").alias("other"), "start", "end").distinct()
    covered = links.join(covers, ["id", "other"]).where("at >= start and at + k <= end").select("seed", "id", "at").distinct()
    left = stored(links.join(covered, ["seed", "id", "at"], "left_anti").select("seed", "id", "at"), "left-open")
    members = shared.join(left.select("seed").distinct(), "seed", "left_semi").join(left.withColumn("open", F.lit(True)), ["seed", "id", "at"], "left")
    asked = members.groupBy("id").agg(F.collect_list(F.struct("seed", "at", "k", (F.col("id") == F.col("other")).alias("hub"), F.coalesce("open", F.lit(False)).alias("open"))).alias("s"))
    asked = nodes.join(asked, "id").select("id", "text", *(F.col(f"s.{c}").alias(c) for c in ("seed", "at", "k", "hub", "open")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 100):
                batch = whole.slice(begin, 100)
                texts, ids = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(0).to_pylist()
                lists = [[x.values.to_numpy(zero_copy_only=False) for x in column] for column in batch.columns[2:]]
                parts = [narrower(hashes_of(t), *columns, min_words) for t, *columns in zip(texts, *lists, strict=True)]
                joined = [np.concatenate([p[c] for p in parts]) for c in range(4)]
                owner = np.repeat(np.array(ids, np.int64), [len(p[0]) for p in parts])
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((joined[0], owner, *joined[1:]), kinds, strict=True)], ["key", "id", "at", "k", "open"])

    narrow = stored(asked.mapInArrow(keys, "key long, id long, at int, k int, open boolean"), "narrower")
    hubs = narrow.groupBy("key").agg(F.min("id").alias("other"), F.max("id").alias("most"), F.max("open").alias("open")).where((F.col("other") != F.col("most")) & F.col("open")).select("key", "other")
    again = stored(narrow.join(hubs.hint("shuffle_hash"), "key").select("key", "id", "other", "at", "k", "open"), "narrower-shared")
    there = again.where("id = other").groupBy("key").agg(F.min("at").alias("there"), F.max("open").alias("hub_open"))
    # two holders that both have passages with the seeds' smallest holder are linked through that
    again = again.where("id != other").join(there, "key").where("open or hub_open").select("id", "other", "at", "there", "k").distinct()
    found = found.unionByName(compared(again)).distinct()
    n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    # words are counted where a text is a copy only: as a condition on both sides of the join it is not pushed below it
    same = known.where("rep is not null and rep != id").select(F.col("id").alias("doc_id"), F.col("rep").alias("other_id"), F.when(F.col("rep") != F.col("id"), n).alias("n"))
    same = same.where(F.col("n") >= min_words).distinct()
    whole = same.select("doc_id", "other_id", F.lit(0).alias("start"), F.col("n").alias("end"), F.lit(0).alias("other_start"), F.col("n").alias("other_end"), F.col("n").alias("matched"), F.lit(True).alias("copy"))
    return found.withColumn("copy", F.lit(False)).unionByName(whole)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents, each as a pair of documents with word positions."""
    return find_passages(table(spark, sf_dir, "documents"))
