"""Near-duplicates by SetSketch: exponentially spaced truncated minima, banded, jointly estimated, then verified.

1. Sketch: each document's set of distinct word shingles gives REGISTERS registers; a register is the truncated
   logarithm (base BASE) of the smallest of the shingles' exponential values, so sketches merge by maximum.
2. Candidates: BANDS bands of ROWS registers. Equal sets are one node. In a bucket each node is compared with the one
   that the most buckets point to, which is the common origin where copies differ among themselves. Nodes that share a
   bucket but are not connected after that are joined on their rarest shingles (prefix_pairs), so no link depends on
   the choice.
3. Estimate: the likelihood of both sketches' register comparisons, given the set sizes, is maximised over the
   similarity; pairs far below the threshold are left out.
4. Verify: full sets are compared; components of the verified links are the groups.

The chance that no band holds a pair of the threshold's similarity is (1 - 0.8^5)^30 = 7e-6, that the estimate drops
it 2e-6. Buckets and groups are only counted, joined and reduced, never gathered.

A caller that runs no Python (`native`) gets other candidates from the same sets: all begin with the smallest of its
shingles' hashes. A set of at most FEW has those that it must share with any set that is similar enough (a prefix); of a
larger one, the ROWS smallest from the start of each of 2^5 equal ranges of hashes on are a band. The chance that no band
holds a pair of the threshold's similarity is at most (1 - 0.8^5)^32 = 3e-6; full sets are compared without an estimate.

Defined results: a null text, one without words, has an empty set, links with nothing and is kept; a row whose id is
null takes the id of its group, or none, and is kept in the latter case; repeated rows share one result; other columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.llm.components import components
from kelpworks.llm.shared import LOWER, UPPER, lasting, only_or_without, passing, stored, table

BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: Fixed values of the sketch: base, rate, and the largest register.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Native sketches: sets up to this size have a prefix; bits of a hash that name its range.
FEW, RANGE_BITS = 150, 5
FOLD = bytes.maketrans(UPPER, LOWER)
SEEDS = np.random.default_rng(7).integers(1, 2**63, size=(2, REGISTERS), dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles_of(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words; of all words together if there are fewer."""
    words = text.translate(FOLD).split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def registers_of(shingles: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    a, b = (s.astype(np.uint32) | np.uint32(1) for s in SEEDS >> np.uint64(17))
    for i in range(0, len(small), 1024):
        h = small[i : i + 1024, None]
        v = (h ^ (h >> np.uint32(15))) * a
        v = (v ^ (v >> np.uint32(13))) * b
        least = np.minimum(least, (v ^ (v >> np.uint32(16))).min(0))
    x = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def likeliest(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Similarities at which the comparisons of the rows of x and y are likeliest, given the sets' sizes."""
    more, less = (x > y).sum(1), (x < y).sum(1)
    same = x.shape[1] - more - less
    u, v = nx / (nx + ny), ny / (nx + ny)

    def p(z: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        up, down = np.clip(p(u - v * j), 1e-9, 1), np.clip(p(v - u * j), 1e-9, 1)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = fit(a) >= fit(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def sketch(docs: DataFrame, size: int, doc_id: str, text: str, sets: bool = False) -> DataFrame:
    """id, s1 and s2 (which name the set; null if empty), n, and registers and band keys, or the set itself."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                names, n, regs, keys, full = [], [], [], [], []
                for data in batch.column(1).cast(pa.binary()).to_pylist():
                    own = shingles_of(data, size)
                    name = xxhash.xxh3_128_digest(own.tobytes())
                    names.append(np.frombuffer(name, np.int64) if len(own) else (None, None))
                    n.append(len(own))
                    if sets:
                        full.append(own.view(np.int64))
                    elif len(own):
                        r = registers_of(own)
                        regs.append(r.tobytes())
                        keys.append(np.array([xxhash.xxh3_64_intdigest(r[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) for i in range(BANDS)], np.uint64).view(np.int64))
                    else:
                        regs.append(None)
                        keys.append(np.empty(0, np.int64))
                lists = full if sets else keys
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32()), pa.array(np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64)))
                head = [batch.column(0), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*head, flat] if sets else [*head, pa.array(regs, pa.binary()), flat], ["id", "s1", "s2", "n", "shingles"] if sets else ["id", "s1", "s2", "n", "regs", "bands"])

    more = "shingles array<long>" if sets else "regs binary, bands array<long>"
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, s1 long, s2 long, n long, {more}")


def bound(c: Column, use) -> Column:
    """use(c), with c worked out once for a row."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def native_sketch(docs: DataFrame, size: int, doc_id: str, text: str, percent: int, sets: bool = False) -> DataFrame:
    """As sketch, by built-in functions and without registers."""

    def shingles(words: Column) -> Column:  # of fewer words than `size` the missing ones are null, which the hash leaves out
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
        return F.when(F.size(words) > 0, F.sort_array(F.array_distinct(each))).otherwise(F.array().cast("array<long>"))

    def keys(own: Column) -> Column:
        n = F.size(own)
        few = F.slice(own, F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int"))
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.shiftright(F.get(own, i - 1), 64 - RANGE_BITS) != F.shiftright(F.get(own, i - 2), 64 - RANGE_BITS)))
        many = bound(F.concat(own, F.slice(own, 1, ROWS - 1)), lambda ring: F.transform(starts, lambda i: F.xxhash64(F.slice(ring, i, F.lit(ROWS)))))
        none = F.array().cast("array<long>")
        return F.when(n == 0, none).otherwise(F.concat(F.when(n * percent <= FEW * 100, few).otherwise(none), F.when(n > FEW, many).otherwise(none)))

    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lower = F.when(F.length(own) == F.octet_length(own), F.lower(own)).otherwise(F.translate(own, UPPER.decode(), LOWER.decode()))
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    name = lambda s, of: F.when(F.size(s) > 0, of)
    own = bound(bound(hashes, shingles), lambda s: F.struct(name(s, F.xxhash64(s)).alias("s1"), name(s, F.xxhash64(F.lit(size), s)).alias("s2"), F.size(s).cast("long").alias("n"), s.alias("shingles") if sets else keys(s).alias("bands")))
    # a generator, so that no filter or projection above works it out again
    return docs.select(F.col(doc_id).alias("id"), F.inline(F.array(own)))


PAIR = ["a1", "a2", "b1", "b2"]


def likely_pairs(pairs: DataFrame, regs: DataFrame, percent: int) -> DataFrame:
    """The pairs that the sketches do not rule out."""
    least = percent / 100 - 4.6 * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    of = lambda s: regs.select(F.col("s1").alias(f"{s}1"), F.col("s2").alias(f"{s}2"), F.col("n").alias(f"{s}_n"), F.col("regs").alias(f"{s}_regs"))
    both = pairs.join(of("a"), ["a1", "a2"]).join(of("b"), ["b1", "b2"])

    def likely(frames):
        for f in frames:
            if len(f):
                x, y = (np.frombuffer(b"".join(f[c]), np.uint16).reshape(len(f), REGISTERS) for c in ("a_regs", "b_regs"))
                f = f[likeliest(x, y, f["a_n"].to_numpy(float), f["b_n"].to_numpy(float)) >= least]
            yield f[PAIR]

    return stored(both.select(*PAIR, "a_n", "b_n", "a_regs", "b_regs").mapInPandas(likely, "a1 long, a2 long, b1 long, b2 long"), "likely")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have at least so many percent in common."""
    of = lambda s: sets.select(F.col("s1").alias(f"{s}1"), F.col("s2").alias(f"{s}2"), F.col("shingles").alias(f"{s}_shingles"))
    full = pairs.join(of("b"), ["b1", "b2"]).join(of("a"), ["a1", "a2"])
    same = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return stored(full.where(100 * same >= percent * (F.size("a_shingles") + F.size("b_shingles") - same)).select(*PAIR), "links")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different groups, one of them `outside`, that can reach the similarity: no such pair is lost.

    Sets are ordered from their rarest shingle on. Two that are similar enough share one within their first
    n - ceil(n * percent / 100) + 1, and at the first that they share enough of both must be left.
    """
    own = nodes.join(sets, ["s1", "s2"])
    single = own.select("s1", "s2", "group", "outside", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    rarity = stored(single.groupBy("shingle").agg(F.count("*").alias("held")), "rarity")
    ordered = single.join(rarity, "shingle").groupBy("s1", "s2", "group", "outside", "n").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("order"))
    prefix = F.slice(F.col("order.shingle"), F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    placed = stored(ordered.select("s1", "s2", "group", "outside", "n", F.posexplode(prefix).alias("at", "shingle")), "prefixes")
    of = lambda df, s: df.select("shingle", *(F.col(c).alias(f"{s}_{c}") for c in ("s1", "s2", "group", "outside", "n", "at")))
    x, y = of(placed.where("outside"), "x"), of(placed, "y")
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))  # the shared one and what follows it
    total = F.col("x_n") + F.col("y_n")
    once = ~F.col("y_outside") | (F.col("x_s1") < F.col("y_s1")) | ((F.col("x_s1") == F.col("y_s1")) & (F.col("x_s2") < F.col("y_s2")))
    sizes = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent
    on = (x["shingle"] == y["shingle"]) & (F.col("x_group") != F.col("y_group")) & sizes & (left * (100 + percent) >= total * percent) & once
    return x.join(y, on).select(F.col("x_s1").alias("a1"), F.col("x_s2").alias("a2"), F.col("y_s1").alias("b1"), F.col("y_s2").alias("b2")).distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, native: bool = False) -> DataFrame:
    """id, n (set size), component (smallest id of the group), one row per row of docs, stored; with `native`, by built-in functions only."""
    with passing(docs.sparkSession):
        return lasting(_near_groups(docs, doc_id, text, size, percent, native), "groups-of-rows")


def _near_groups(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, native: bool) -> DataFrame:
    sketched = lambda df, doc_id, text, **more: native_sketch(df, size, doc_id, text, percent, **more) if native else sketch(df, size, doc_id, text, **more)
    sketches = stored(sketched(docs, doc_id, text), "sketches")
    nodes = stored(sketches.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "nodes")
    placed = sketches.select("s1", "s2", "n", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low != high").select("band")
    members = stored(placed.join(shared, "band").select("band", "s1", "s2", "n").distinct(), "members")
    counts = stored(members.groupBy("band").agg(F.count("*").alias("held")), "bands")
    degree = stored(members.join(counts, "band").groupBy("s1", "s2").agg(F.sum("held").alias("degree")), "degrees")
    hubs = stored(members.join(degree, ["s1", "s2"]).groupBy("band").agg(F.max(F.struct("degree", "s1", "s2", "n")).alias("hub")).select("band", F.col("hub.s1").alias("a1"), F.col("hub.s2").alias("a2"), F.col("hub.n").alias("a_n")), "hubs")
    sizes = F.least("n", "a_n") * 100 >= F.greatest("n", "a_n") * percent
    pairs = stored(members.join(hubs, "band").where(((F.col("s1") != F.col("a1")) | (F.col("s2") != F.col("a2"))) & sizes).select("a1", "a2", F.col("s1").alias("b1"), F.col("s2").alias("b2")).distinct(), "pairs")

    inner = stored(degree.join(nodes, ["s1", "s2"]).select("s1", "s2", F.col("rep").alias("id")), "inner")  # nodes with a candidate
    if not native:
        regs = only_or_without(sketches.select("id", "s1", "s2", "n", "regs"), inner, "left_semi", ["id", "s1", "s2"])
        regs = stored(regs.select("s1", "s2", "n", "regs"), "registers")
    texts = only_or_without(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), inner, "left_semi", ["id"])
    sets = only_or_without(sketched(texts, "id", "text", sets=True), inner, "left_semi", ["id", "s1", "s2"]).select("s1", "s2", "shingles")
    sets = stored(sets, "sets")
    if sets.count() > inner.count():  # repeated rows
        sets = stored(sets.dropDuplicates(["s1", "s2"]), "once")
        if not native:
            regs = stored(regs.dropDuplicates(["s1", "s2"]), "once")
    checked = lambda pairs: verified(pairs if native else likely_pairs(pairs, regs, percent), sets, percent)

    named = nodes.select("s1", "s2", F.struct("rep", "s1", "s2").alias("node"))
    label = lambda links: components(
        links.join(named.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("node").alias("a")), ["a1", "a2"]).join(named.select(F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("node").alias("b")), ["b1", "b2"]), "groups"
    )
    links = checked(pairs)
    labels = label(links)

    # what one bucket holds but the links with its hub don't connect: the nodes outside its largest group against all of these
    at = labels.select(F.col("node.s1").alias("s1"), F.col("node.s2").alias("s2"), F.xxhash64("label").alias("group"))
    many = members.join(counts.where("held > 2").select("band"), "band").join(at, ["s1", "s2"], "left")
    many = stored(many.select("band", "s1", "s2", F.coalesce("group", F.xxhash64("s1", "s2")).alias("group")), "grouped")
    sizes = many.groupBy("band", "group").agg(F.count("*").alias("own"))
    largest = stored(sizes.groupBy("band").agg(F.max(F.struct("own", "group")).alias("top"), F.count("*").alias("groups")).where("groups > 1").select("band", F.col("top.group").alias("top")), "largest")
    open_ = many.join(largest, "band")
    open_ = stored(open_.groupBy("s1", "s2", "group").agg(F.max(F.col("group") != F.col("top")).alias("outside")), "open")
    rest = prefix_pairs(open_, sets, percent)
    more = checked(stored(rest, "rest"))
    if not more.isEmpty():
        labels = label(links.unionByName(more))

    group = nodes.join(labels.select(F.col("node.s1").alias("s1"), F.col("node.s2").alias("s2"), F.col("label.rep").alias("least")), ["s1", "s2"], "left")
    group = stored(group.where("copies > 1 or least is not null").select("s1", "s2", F.coalesce("least", "rep").alias("component")), "components")
    return sketches.select("id", "s1", "s2", "n").join(group, ["s1", "s2"], "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs without those of a group but its smallest id, all columns as they were; of repeated rows one stays.

    An id names one document: rows of one id go or stay together, and of those with one text the first is kept.
    """
    found = near_groups(docs, doc_id, text, size, percent)
    gone = found.where("id != component").select(F.col("id").alias("__id"))
    kept = only_or_without(docs.withColumn("__id", F.col(doc_id)), gone, "left_anti", ["__id"])
    again = stored(found.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("__id")), "repeated")
    if not again.isEmpty():
        once = only_or_without(kept, again, "left_semi", ["__id"]).dropDuplicates([doc_id, text])
        kept = only_or_without(kept, again, "left_anti", ["__id"]).unionByName(once)
    return kept.select(*docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 2-word shingles have a similarity of 0.8 or more."""
    found = near_groups(table(spark, sf_dir, "documents"), size=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()).alias("kept"))


#: The same in DuckDB: shared shingles of distinct sets are counted pair by pair, links followed to the smallest id.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS sh FROM d
), nodes AS (
  SELECT min(doc_id) AS node, sh FROM s WHERE len(sh) > 0 GROUP BY sh
), one AS (
  SELECT node, len(sh) AS n, unnest(sh) AS x FROM nodes
), links AS (
  SELECT a.node AS a, b.node AS b FROM one a JOIN one b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT node, node AS label FROM nodes
  UNION
  SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.node
), least_of AS (
  SELECT node, min(label) AS label FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(label, s.doc_id) AS component_id, s.doc_id = coalesce(label, s.doc_id) AS kept
FROM s LEFT JOIN nodes ON nodes.sh = s.sh LEFT JOIN least_of ON least_of.node = nodes.node
"""
