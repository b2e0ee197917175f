"""The structure of a document's lines as native expressions: heading paths (W6) and merged continuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpworks.functions.text import clean_text, edged, hierarchy_level, is_heading, is_new_item, is_project_line, is_table_line, normalize_match

#: Levels, a number with its unit, how a continuation begins, and what announces one.
LEVELS = (1, 2, 3, 4, 5)
UNIT = edged(r"\b\d+(?:[.,]\d+)?\s*(?:ha|m2|%|ty)\b")
LEAD = edged(r"^(?:[-+*]|\d+[.)]?|(?:tong|trong do|cu the|gom|la|dat|du an|cong trinh|ha)\b)")
SIGNAL = r"(?::|la|gom|cu the|trong do)$"
#: Characters and lines of a short block.
SHORT_CHARS, SHORT_LINES = 260, 4
#: Blocks that are folded at a time (an array that grows by one is copied each time), and characters at the seam of two blocks.
CHUNK, SEAM = 256, 200
BLOCK = "struct<content:string,chunk_type:string,page:int,heading:string,path:string,chunker:string>"


def heading_level(line: Column) -> Column:
    """The level that a line opens in the default chunking mode: 1 to 3; a heading of no level counts as 3; body lines null."""
    level = hierarchy_level(line)
    loose = is_heading(line) & ~is_new_item(line) & ~is_table_line(line) & ~is_project_line(line)
    return F.when(level <= 3, level).when(loose, F.lit(3))


def heading_paths(lines: DataFrame, document: list[str], position: str, text: str = "line", level: str = "level") -> DataFrame:
    """Lines with `path`, the headings in force at each line, outermost first: array<struct<level, text>>.

    Each level keeps its last heading in a running window; it is void where one of a higher level came later. A heading is in
    force on its own line. Rows without a level only need document and position, so a caller may leave their text null.
    Repeated documents need a key of their own; positions must differ within a document.
    """
    running = Window.partitionBy(*document).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.struct(F.col(position).alias("at"), F.lit(0).alias("level"), F.col(text).alias("text"))
    names = [f"__level_{n}" for n in LEVELS]
    seen = lines.withColumns({name: F.last(F.when(F.col(level) == n, here), ignorenulls=True).over(running) for n, name in zip(LEVELS, names, strict=True)})
    kept = []
    for i, n in enumerate(LEVELS):
        higher = [F.col(names[j])["at"] for j in range(i)]
        last_higher = higher[0] if len(higher) == 1 else F.greatest(*higher) if higher else F.lit(None)
        in_force = F.col(names[i]).isNotNull() & (last_higher.isNull() | (last_higher < F.col(names[i])["at"]))
        kept.append(F.when(in_force, F.struct(F.lit(n).alias("level"), F.col(names[i])["text"].alias("text"))))
    return seen.withColumn("path", F.filter(F.array(*kept), lambda x: x.isNotNull())).drop(*names)


def starts_continuation(line: Column) -> Column:
    """A bullet, a number, or a word that goes on with what was said."""
    return normalize_match(line).rlike(LEAD)


#: What cleaning would change.
UNCLEAN = r"[\x00\t]|\x20{2}|\n{3}|^\s"
#: Characters of a normal form that SIGNAL needs.
SIGNAL_CHARS = 10
FIELDS = ("content", "chunk_type", "page", "heading", "path", "chunker")


def _same(a: Column, b: Column) -> Column:
    """Both are there, not empty, and equal."""
    return F.coalesce((a != "") & (a == b), F.lit(False))


def _looked_at(block: Column) -> Column:
    """A cleaned block with what the fold asks of it, worked out once: how it begins and ends, its figures and table lines."""

    def seen(x: Column) -> Column:
        lines, flat = x["lines"], x["flat"]
        shown = F.filter(lines, lambda line: F.trim(line) != "")
        short = (F.length(block["content"]) <= SHORT_CHARS) | (F.size(lines) <= SHORT_LINES)
        lead = F.when(F.size(lines) == 1, flat.rlike(LEAD)).otherwise(starts_continuation(lines[0]))
        return F.struct(
            *(block[c].alias(c) for c in FIELDS), lead.alias("lead"), _signals(flat).alias("signal"), flat.rlike(UNIT).alias("measured"), short.alias("short"),
            F.contains(block["content"], F.lit("|")).alias("bar"), F.size(F.filter(shown, lambda line: is_table_line(F.trim(line)))).alias("tables"), F.size(shown).alias("lines"),
        )

    forms = F.struct(F.split(block["content"], "\n").alias("lines"), normalize_match(block["content"]).alias("flat"))
    return F.transform(F.array(forms), seen)[0]


def _signals(flat: Column) -> Column:
    """Ends in a colon or a word that something must follow."""
    return F.right(flat, F.lit(SIGNAL_CHARS)).rlike(SIGNAL)


def _is_text(b: Column) -> Column:
    table = b["bar"] | (b["tables"] >= F.greatest(F.lit(2), F.floor(b["lines"] / 2)))
    return F.coalesce(F.nullif(b["chunk_type"], F.lit("")) == "text", ~table)


def _goes_on(open_: Column, block: Column) -> Column:
    near = F.coalesce(open_["page"] == block["page"], F.lit(False)) | _same(open_["heading"], block["heading"]) | _same(open_["path"], block["path"])
    said = open_["signal"] | block["lead"] | (block["short"] & block["measured"] & ~open_["measured"])
    return said & near & _is_text(open_) & _is_text(block)


def _merged(open_: Column, block: Column) -> Column:
    """The open block with the other one added; what its end and its figures say is looked for across the seam too."""
    content = clean_text(F.concat(open_["content"], F.lit("\n"), block["content"]))
    seam = normalize_match(F.concat(F.right(open_["content"], F.lit(SEAM)), F.lit("\n"), block["content"]))
    filled = lambda c: F.coalesce(F.nullif(open_[c], F.lit("")), block[c]).alias(c)
    named = F.concat(F.coalesce(F.nullif(open_["chunker"], F.lit("")), F.lit("unknown")), F.lit("+ContinuationMerge"))
    return F.struct(
        content.alias("content"), open_["chunk_type"].alias("chunk_type"), F.coalesce(open_["page"], block["page"]).alias("page"), filled("heading"), filled("path"), named.alias("chunker"), open_["lead"].alias("lead"),
        (block["signal"] | _signals(seam)).alias("signal"), (open_["measured"] | block["measured"] | seam.rlike(UNIT)).alias("measured"), open_["short"].alias("short"),
        (open_["bar"] | block["bar"]).alias("bar"), (open_["tables"] + block["tables"]).alias("tables"), (open_["lines"] + block["lines"]).alias("lines"),
    )


def merge_continuations(blocks: Column) -> Column:
    """An array of BLOCK in which each block that goes on with the one before, as merged so far, is added to it.

    An ordered fold: the state is the list of closed blocks and the open one, so a chain of any length is compared with all
    that it has taken up. Blocks without text go; nulls in any field count as not given; a null array stays null.
    """
    state = BLOCK[:-1] + ",lead:boolean,signal:boolean,measured:boolean,short:boolean,bar:boolean,tables:int,lines:int>"
    none, closed = F.lit(None).cast(state), F.array().cast(f"array<{BLOCK}>")
    plain = lambda b: F.struct(*(b[c].alias(c) for c in FIELDS))
    whole = lambda b: F.when(b["content"].rlike(UNCLEAN) | F.right(b["content"], F.lit(1)).rlike(r"\s"), clean_text(b["content"])).otherwise(b["content"])
    cleaned = F.filter(F.transform(blocks, lambda b: F.struct(whole(b).alias("content"), *(b[c].alias(c) for c in FIELDS[1:]))), lambda b: b["content"] != "")

    def step(a: Column, b: Column) -> Column:
        start = F.struct(a["closed"].alias("closed"), b.alias("open"))
        joined = F.struct(a["closed"].alias("closed"), _merged(a["open"], b).alias("open"))
        apart = F.struct(F.concat(a["closed"], F.array(plain(a["open"]))).alias("closed"), b.alias("open"))
        return F.when(a["open"].isNull(), start).when(_goes_on(a["open"], b), joined).otherwise(apart)

    def chunk(a: Column, part: Column) -> Column:
        done = F.aggregate(F.transform(part, _looked_at), F.struct(closed.alias("closed"), a["open"].alias("open")), step)
        return F.struct(F.concat(a["closed"], done["closed"]).alias("closed"), done["open"].alias("open"))

    def parts(rows: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(CHUNK))
        return F.transform(firsts, lambda first: F.slice(rows, first, CHUNK))

    begin = F.struct(closed.alias("closed"), none.alias("open"))
    ended = lambda a: F.when(a["open"].isNull(), a["closed"]).otherwise(F.concat(a["closed"], F.array(plain(a["open"]))))
    # Lambdas bind what is used twice, so that it is worked out once.
    dealt = F.transform(F.array(cleaned), parts)[0]
    return F.when(blocks.isNotNull(), F.aggregate(dealt, begin, chunk, lambda a: F.transform(F.array(a), ended)[0]))
