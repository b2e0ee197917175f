"""Conversation structure repair: the cheapest edits that make a conversation `system? (user assistant)+`, or empty.

1. Windows over a conversation's turns give each row's fault: blank, duplicate of an earlier row, or truncated; the first
   that holds counts.
2. Rows are dealt by conversation and block of BLOCK turns, so that a long conversation is spread over tasks, and collected
   as sorted structs. What a row repeats from an earlier block is found by the smallest block of each (role, text).
3. aggregate() folds a block's rows over four (cost, audit) structs, one for each place in the grammar: nothing yet, after
   the system turn, after a user turn, after an assistant turn. Only least() chooses, so equal costs go to the audit that
   sorts first. A block that isn't the first is folded once from each of the four places.
4. The blocks of a conversation are folded in order in the same way, and the chosen edits are applied block by block.

The text of one conversation meets in one row at the end, since its repaired form is one value; nothing else does.

Defined results: turns sort by number, null first, then by role and text; null conv_id, role or text: the rows without an
id are one conversation, a null role or text is one space; a conversation none of whose rows is left has zeros and an
empty repair; a role's first character decides, so unknown roles can only be changed or deleted; extra columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpworks.llm.shared import table

#: White space; cost of an edit, and what an undeleted truncated row adds.
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turn numbers in a block.
BLOCK = 256
#: More than any repair costs.
NEVER = 1 << 60
#: What a fold holds for one place in the grammar, and how many places there are.
PLACE, PLACES = "struct<cost:bigint,audit:string>", 4


def _plus(place: Column, cost, letter: str) -> Column:
    return F.struct((place["cost"] + cost).cast("long").alias("cost"), F.concat(place["audit"], F.lit(letter)).alias("audit"))


def _named(places: list[Column]) -> Column:
    return F.struct(*(p.alias(f"p{i}") for i, p in enumerate(places)))


def _step(a: Column, row: Column) -> Column:
    """One row: it is deleted, or kept or given another role where the grammar allows."""
    extra = F.when(row["truncated"], F.lit(TRUNCATED)).otherwise(F.lit(0))
    gone = [_plus(a[f"p{i}"], DELETE, "D") for i in range(PLACES)]
    open_, user = F.least(a["p0"], a["p1"], a["p3"]), a["p2"]
    is_, usable = lambda letter: row["initial"] == letter, ~row["must_go"]
    none = F.lit(None).cast(PLACE)
    after = [
        gone[0],
        F.least(gone[1], F.when(usable & is_("s"), _plus(a["p0"], extra + KEEP, "K")).otherwise(none)),
        F.least(gone[2], F.when(usable, F.when(is_("u"), _plus(open_, extra + KEEP, "K")).otherwise(_plus(open_, extra + REROLE, "R"))).otherwise(none)),
        F.least(gone[3], F.when(usable, F.when(is_("a"), _plus(user, extra + KEEP, "K")).otherwise(_plus(user, extra + REROLE, "R"))).otherwise(none)),
    ]
    return _named(after)


def _opened(a: Column) -> Column:
    """The places after as many inserted turns as pay; a lambda binds the user's place, so that it is worked out once."""
    user = F.least(a["p2"], *(_plus(a[p], INSERT, "I") for p in ("p0", "p1", "p3")))
    return F.transform(F.array(user), lambda u: F.struct(a["p0"].alias("p0"), a["p1"].alias("p1"), u.alias("p2"), F.least(a["p3"], _plus(u, INSERT, "I")).alias("p3")))[0]


def _fold(rows: Column, start: Column) -> Column:
    """An array of the four places after the rows, from place number `start` on."""
    begin = [F.struct(F.when(start == i, F.lit(0)).otherwise(F.lit(NEVER)).cast("long").alias("cost"), F.lit("").alias("audit")) for i in range(PLACES)]
    opened = F.aggregate(rows, _named(begin), lambda a, r: F.transform(F.array(_opened(a)), lambda o: _step(o, r))[0], _opened)
    return F.array(*(opened[f"p{i}"] for i in range(PLACES)))


def _joined(a: Column, block: Column) -> Column:
    """Places after one more block: each by the best place to enter the block from."""

    def reach(i: int) -> Column:
        ways = [
            F.struct(
                (a[f"p{o}"]["cost"] + block["ways"][o][i]["cost"]).alias("cost"),
                F.concat(a[f"p{o}"]["audit"], block["ways"][o][i]["audit"]).alias("audit"),
                F.concat(a[f"p{o}"]["pieces"], F.array(F.struct(F.lit(o).alias("start"), block["ways"][o][i]["audit"].alias("audit")))).alias("pieces"),
            )
            for o in range(PLACES)
        ]
        return F.least(*ways)

    return _named([reach(i) for i in range(PLACES)])


def _applied(rows: Column, piece: Column) -> Column:
    """The lines of a block after its edits: role:text of each turn that stays."""
    letters = F.filter(F.split(piece["audit"], ""), lambda c: c != "")

    def edit(a: Column, letter: Column) -> Column:
        row, takes = F.get(rows, a["at"]), (letter != "I").cast("int")
        role = F.when(letter == "K", row["role"]).when(a["user_next"], F.lit("user")).otherwise(F.lit("assistant"))
        line = F.concat(role, F.lit(":"), F.when(letter == "I", F.lit("")).otherwise(row["text"]))
        system = (letter == "K") & (row["initial"] == "s")
        return F.when(letter == "D", F.struct((a["at"] + 1).alias("at"), a["user_next"].alias("user_next"), a["out"].alias("out"))).otherwise(
            F.struct((a["at"] + takes).alias("at"), F.when(system, a["user_next"]).otherwise(~a["user_next"]).alias("user_next"), F.concat(a["out"], F.array(line)).alias("out"))
        )

    begin = F.struct(F.lit(0).alias("at"), (piece["start"] != 2).alias("user_next"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(letters, begin, edit, lambda a: a["out"])


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with block, initial, truncated, and fault: the first of blank, duplicate, truncated, or null.

    Nulls of role and text are one space. A duplicate repeats role and text of an earlier row of its conversation.
    """
    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    placed = filled.withColumns({"block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long"), "key": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))})
    # Only conversations of several blocks can repeat a row of an earlier one.
    long = placed.groupBy("conv_id").agg(F.min("block").alias("first"), F.max("block").alias("last")).where("first < last").select(F.col("conv_id").alias("of"))
    several = placed.select("conv_id", "block", "key").join(long, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    spread = several.distinct().withColumn("first", F.min("block").over(Window.partitionBy("conv_id", "key"))).where("first < block")
    repeated = spread.select(F.col("conv_id").alias("of"), F.col("block").alias("in"), F.col("key").alias("is"), F.lit(True).alias("again"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")) & (F.col("key") == F.col("is"))
    within = Window.partitionBy("conv_id", "block", "key").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim("text", F.lit(SPACE))
    kind = (
        F.when(F.length(bare) == 0, F.lit("blank"))
        .when((F.row_number().over(within) > 1) | F.coalesce("again", F.lit(False)), F.lit("duplicate"))
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), F.lit("truncated"))
    )
    return placed.join(repeated, same, "left").select("conv_id", "turn", "role", "text", "block", F.substring("role", 1, 1).alias("initial"), kind.alias("fault"))


def repair(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (the text).

    Edits: K keep, R give the role that fits (user or assistant), D delete, I insert an empty turn; blank and duplicate rows
    must be deleted. audit lists them in order.
    """
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated"))
    along = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.lag("initial").over(along)
    legal = ["su", "ua", "au"]
    counted = {k: F.sum((F.col("fault") == k).cast("long")).alias(k) for k in ("blank", "duplicate", "truncated")}
    blocks = (
        faults(turns).withColumn("breaks", (before.isNotNull() & ~F.concat(before, F.col("initial")).isin(*legal)).cast("long"))
        .groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(order)).alias("rows"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("turns"), F.sum("breaks").alias("breaks"), *counted.values())
    )
    ways = F.transform(F.array(*(F.lit(i) for i in range(PLACES))), lambda o: _fold(F.col("rows"), o))
    kept = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"), r["initial"].alias("initial")))
    ends = F.struct(F.col("rows")[0]["initial"].alias("head"), F.element_at("rows", -1)["initial"].alias("tail"))
    folded = blocks.select("conv_id", "low", "high", "turns", "breaks", *counted, F.struct("block", ways.alias("ways"), kept.alias("rows"), ends.alias("ends")).alias("piece"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    whole = folded.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"), *(total(k).alias(k) for k in counted), total("breaks").alias("breaks"),
        F.array_sort(F.collect_list("piece"), lambda x, y: F.when(x["block"] < y["block"], -1).when(x["block"] > y["block"], 1).otherwise(0)).alias("pieces"),
    )
    none = F.array().cast("array<struct<start:int,audit:string>>")
    begin = _named([F.struct(F.lit(0 if i == 0 else NEVER).cast("long").alias("cost"), F.lit("").alias("audit"), none.alias("pieces")) for i in range(PLACES)])
    best = F.aggregate("pieces", begin, _joined, lambda a: F.least(a["p0"], a["p3"]))
    tails, heads = F.slice("pieces", F.lit(1), F.size("pieces") - 1), F.slice("pieces", F.lit(2), F.size("pieces") - 1)
    between = F.size(F.filter(F.zip_with(tails, heads, lambda x, y: F.concat(x["ends"]["tail"], y["ends"]["head"]).isin(*legal)), lambda fine: ~fine))
    chosen = whole.withColumn("best", best)
    lines = F.flatten(F.zip_with("pieces", F.col("best")["pieces"], lambda block, piece: _applied(block["rows"], piece)))
    return chosen.select("conv_id", "gaps", *counted, (F.col("breaks") + between).alias("illegal"), F.col("best")["cost"].alias("cost"), F.col("best")["audit"].alias("audit"), F.array_join(lines, "\n").alias("repaired"))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of the contract's damage: by crc32(conv_id:turn) % 20 one is dropped, emptied, cut, repeated or given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(part("role"))
    times = F.when(fault == 0, F.lit(0)).when(fault == 3, F.lit(2)).otherwise(F.lit(1))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.array_repeat(F.lit(0), times).alias("copies"))
    return rows.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What it takes to repair each conversation after the contract's damage."""
    turns = table(spark, sf_dir, "conversations")
    found = repair(damaged(turns)).withColumnRenamed("conv_id", "id")
    every = turns.select("conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256")
    )


#: The same in DuckDB: crc32 by its table, then one row a round through a recursion that carries cost, audit and lines.
OP12_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), keyed AS (
  SELECT c.conv_id, c.turn, coalesce(c.role, ' ') AS role, coalesce(c.text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(c.turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS bytes, t
  FROM conversations c, crc
), numbered AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS k FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM numbered
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt
), marked AS (
  SELECT conv_id, turn, role, text, i, role[1:1] AS r,
         CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] NOT IN ('su', 'ua', 'au') AS breaks
  FROM ordered
), places AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS p0, {'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''} AS p1,
         {'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''} AS p2, {'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''} AS p3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i,
         {'c': p0.c + 2, 'a': p0.a || 'D', 't': p0.t},
         least({'c': p1.c + 2, 'a': p1.a || 'D', 't': p1.t}, CASE WHEN usable AND r = 's' THEN {'c': p0.c + extra, 'a': p0.a || 'K', 't': p0.t || chr(10) || role || ':' || text} END),
         least({'c': u.c + 2, 'a': u.a || 'D', 't': u.t}, CASE WHEN usable AND r = 'u' THEN {'c': o.c + extra, 'a': o.a || 'K', 't': o.t || chr(10) || role || ':' || text}
                                                             WHEN usable THEN {'c': o.c + extra + 1, 'a': o.a || 'R', 't': o.t || chr(10) || 'user:' || text} END),
         least({'c': w.c + 2, 'a': w.a || 'D', 't': w.t}, CASE WHEN usable AND r = 'a' THEN {'c': u.c + extra, 'a': u.a || 'K', 't': u.t || chr(10) || role || ':' || text}
                                                             WHEN usable THEN {'c': u.c + extra + 1, 'a': u.a || 'R', 't': u.t || chr(10) || 'assistant:' || text} END)
  FROM (
    SELECT *, least(p0, p1, w) AS o FROM (
      SELECT *, least(p3, {'c': u.c + 5, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}) AS w FROM (
        SELECT places.conv_id, p0, p1, p3, marked.i, marked.r, marked.role, marked.text, fault NOT IN ('blank', 'duplicate') AS usable, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra,
               least(p2, {'c': p0.c + 5, 'a': p0.a || 'I', 't': p0.t || chr(10) || 'user:'}, {'c': p1.c + 5, 'a': p1.a || 'I', 't': p1.t || chr(10) || 'user:'}, {'c': p3.c + 5, 'a': p3.a || 'I', 't': p3.t || chr(10) || 'user:'}) AS u
        FROM places JOIN marked ON places.conv_id IS NOT DISTINCT FROM marked.conv_id AND marked.i = places.i + 1
      )
    )
  )
), last AS (
  SELECT conv_id, least(p0, p3, {'c': u.c + 5, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}) AS best FROM (
    SELECT *, least(p2, {'c': p0.c + 5, 'a': p0.a || 'I', 't': p0.t || chr(10) || 'user:'}, {'c': p1.c + 5, 'a': p1.a || 'I', 't': p1.t || chr(10) || 'user:'}, {'c': p3.c + 5, 'a': p3.a || 'I', 't': p3.t || chr(10) || 'user:'}) AS u
    FROM (SELECT *, i = max(i) OVER (PARTITION BY conv_id) AS final FROM places) WHERE final
  )
), counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (breaks) AS illegal
  FROM marked GROUP BY conv_id
)
SELECT last.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c AS cost, best.a AS audit, sha256(best.t[2:]) AS repaired_sha256
FROM last LEFT JOIN counts ON last.conv_id IS NOT DISTINCT FROM counts.conv_id
"""
