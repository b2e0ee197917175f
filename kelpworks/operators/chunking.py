"""Chunkers: documents into pieces, one document at a time inside Arrow batches (their state runs along its lines)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from kelpworks.functions.text import AREA, HEADING, PROJECT_COLUMNS, PROJECT_WORDS, TELLING
from kelpworks.operators.search import folded

#: Separators in order of preference, sizes and overlaps, and limits of chunks.
SEPARATORS = ("\n\n=== ", "\n\n---", "\n\n", "\n", ". ", " ", "")
SIZES = {"default": (2000, 200), "listing": (900, 120), "planning": (1500, 120)}
#: Characters of the texts that are taken from a batch at a time.
SLICE = 1_000_000
DECISION_MOST, SECTION_MOST, TABLE_MOST, TABLE_ROWS = 2200, 1900, 2100, 4
LEADS = r"^(?:[-+*]|\d+[.)]?)\s*|^(?:tong|trong do|cu the|gom|la|dat|du an|cong trinh|ha)\b"
UNIT = r"\b\d+(?:[.,]\d+)?\s*(?:ha|m2|%|ty)\b"


def split_text(text: str, size: int = 2000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut at the first separator present (kept in front), again within what is too long, then joined up to the size."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    if sep:
        raw = text.split(sep)
        pieces = [p for p in [raw[0], *(sep + r for r in raw[1:])] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    small: list[str] = []
    for piece in pieces:
        if len(piece) < size or not rest:
            small.append(piece)
            continue
        out += _joined(small, size, overlap)
        small = []
        out += split_text(piece, size, overlap, rest)
    return out + _joined(small, size, overlap)


def _joined(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, now, total = [], [], 0
    for piece in pieces:
        if now and total + len(piece) > size:
            if whole := "".join(now).strip():
                out.append(whole)
            while now and (total > overlap or total + len(piece) > size):
                total -= len(now.pop(0))
        now.append(piece)
        total += len(piece)
    if whole := "".join(now).strip():
        out.append(whole)
    return out


def flat(line: str) -> str:
    return folded(line)


def level_of(line: str, form: str | None = None) -> int | None:
    """H16 for one line, here and below with its folded form if that is at hand."""
    f, raw = flat(line) if form is None else form, line.strip()
    rules = ((1, re.match(r"phan\s+[ivxlcdm]+\b|chuong\s+[ivxlcdm0-9]+\b", f) or re.match(r"[A-ZĐ]\s+\S+", raw)), (2, re.match(r"muc\s+\d+(?:\.\d+){0,3}\b", f) or re.match(r"[IVXLCDM]+\s+\S+", raw)), (3, re.match(r"\d+\.\d+(?:\.\d+){0,3}\b", f)), (4, re.match(r"\d+[.)]\s+\S+", f)), (5, re.match(r"[a-z][.)]\s+\S+", f)))
    return next((n for n, hit in rules if hit), None)


def is_table(line: str) -> bool:
    return "|" in line or (len(re.findall(r"\d+[\d.,]*", line)) >= 3 and len(line.split()) >= 6)


def is_heading(line: str) -> bool:
    if not (bare := line.strip()):
        return False
    if len(bare) <= 150 and len(letters := [c for c in bare if c.isalpha()]) >= 8 and sum(c.isupper() for c in letters) >= 0.78 * len(letters):
        return True
    return bool(re.match(HEADING, flat(line)))


def is_project(line: str, form: str | None = None) -> bool:
    f = flat(line) if form is None else form
    return bool(f) and (any(w in f for w in PROJECT_WORDS) or is_table(line) or bool(re.search(AREA, f)))


def is_project_header(line: str, form: str | None = None) -> bool:
    f = flat(line) if form is None else form
    named = sum(w in f for w in PROJECT_COLUMNS)
    return named >= 3 or (named == 2 and bool(re.match(r"s?tt\b", f)))


def is_new_item(line: str) -> bool:
    return bool(re.match(r"(\d+|[a-z]|[ivxlcdm]+)[.)]\s+\S+", flat(line)))


def is_weak(text: str) -> bool:
    lines = [x for x in text.strip().split("\n") if x.strip()]
    return not lines or (len(lines) == 1 and lines[0].strip().isdigit()) or (len(lines) <= 2 and len(text.split()) <= 6 and not re.search(UNIT, flat(text)) and not any(m in flat(text) for m in TELLING))


#: What the archetype is told by: column names, and what the lines' beginnings are.
TABLE_MARKERS = ("danh muc cong trinh", "du an", "ma loai dat", "dien tich ke hoach", "dien tich thu hoi", "can cu phap ly", "ghi chu", "hdnd thanh pho")
RAW_STARTS = {"roman": r"[IVXLCDM]+\s+\S+", "alpha": r"[A-ZĐ]\s+\S+"}
FLAT_STARTS = {"letter": r"[a-z][.)]\s+\S+", "number": r"\d+[.)]\s+\S+"}


def archetype(lines: list[str]) -> str:
    """Of the first 700 lines, by what kinds of lines there are."""
    rows = [(x.strip(), flat(x)) for x in lines[:700]]
    whole = " ".join(f for _, f in rows)[:140_000]
    if "quyet dinh" in whole and whole.count("can cu") >= 2 and re.search(r"\bdieu\s+\d+\b", whole):
        return "decision"
    n: Counter[str] = Counter()
    for raw, f in rows:
        n.update(k for k, p in RAW_STARTS.items() if re.match(p, raw))
        n.update(k for k, p in FLAT_STARTS.items() if re.match(p, f))
        n["level"] += level_of(raw, f) is not None
        n["header"] += is_project_header(raw, f)
        n["project"] += is_project(raw, f) and (f[:1].isdigit() or " du an " in f" {f} ")
    nested = n["alpha"] and n["roman"] and (n["letter"] or n["header"]) and n["project"] >= 2
    listed = sum(m in whole for m in TABLE_MARKERS) >= 2 and n["level"] >= 5 and n["number"] >= 2
    return "hierarchical_table" if nested or listed else "narrative_report"


def chunk(content: str, page: int, kind: str, chunker: str, **more) -> dict:
    return {"content": content, "chunk_type": kind, "page_number": page, "chunker": chunker, "section_heading": None, "hierarchy_path": None, "hierarchy_level": None, "parent_chunk_id": None, "is_parent": False} | more


def hierarchical(pages: list[list[str]], mode: str = "parent_context") -> list[dict]:
    """T4: blocks under their headings. parent_context puts the path in front; parent_child emits the path as a chunk of its own."""
    out: list[dict] = []
    path: dict[int, str] = {}
    parents: dict[str, str] = {}
    for number, lines in enumerate(pages, 1):
        body: list[str] = []
        header: list[str] = []

        def flush(number: int = number) -> None:
            nonlocal body
            text = "\n".join(body).strip()
            body = []
            if not text or is_weak(text):
                return
            names = [path[k] for k in sorted(path)]
            where = " > ".join(names)
            kind = "table" if any(map(is_table, text.split("\n"))) else "text"
            more = {"section_heading": names[-1] if names else None, "hierarchy_path": where or None, "hierarchy_level": max(path, default=None)}
            if mode == "parent_child" and where:
                if where not in parents:
                    parents[where] = f"planning_hierarchy_{re.sub(r"[^a-z0-9]+", "_", folded(where)).strip("_")[:96] or "root"}_p{number}"
                    out.append(chunk(where, number, "text", "hierarchical", **more | {"is_parent": True, "parent_chunk_id": parents[where]}))
                more["parent_chunk_id"] = parents[where]
            elif where:
                text = "\n".join([f"[hierarchy_path={where}]", *(f"[h{k}={path[k]}]" for k in sorted(path)), text])
            out.append(chunk(text, number, kind, "hierarchical", **more))

        for line in lines:
            level = level_of(line) or (3 if is_heading(line) and not is_new_item(line) and not is_project(line) else None)
            if level is not None and level <= 3 and not is_table(line):
                flush()
                header = []
                path = {k: x for k, x in path.items() if k < level} | {level: line.strip()}
            elif is_table(line):
                if not header and "|" in line and not re.search(r"\d", line):
                    header = [line]
                    continue
                if body and not is_table(body[-1]):
                    flush()
                body += [*([] if any(is_table(x) for x in body) else header), line]
                if len(body) - len(header) >= TABLE_ROWS:
                    flush()
            else:
                if body and is_table(body[-1]):
                    flush()
                body.append(line)
                if len(body) >= 14 or sum(map(len, body)) >= 1700:
                    flush()
        flush()
    return once(out)


def contextual(pages: list[list[str]]) -> list[dict]:
    """T5: blocks of lines below the open headings, which go on over pages. A block ends at a heading, at a new item after
    a project's lines, and when full (14 lines, 1700 characters); the line that filled it then also opens the next one."""
    out: list[dict] = []
    path: dict[int, str] = {}
    block: list[str] = []

    def close(number: int) -> None:
        if block:
            names = [path[k] for k in sorted(path)]
            body = "\n".join(block)
            more = {"section_heading": names[-1] if names else None, "hierarchy_path": " > ".join(names) or None, "hierarchy_level": max(path, default=None)}
            out.append(chunk("\n".join([*(f"[h{k}={path[k]}]" for k in sorted(path)), body]), number, "table" if is_project(body) else "text", "contextual", **more))
            block.clear()

    for number, lines in enumerate(pages, 1):
        for line in (x.strip() for x in lines if x.strip()):
            level = level_of(line)
            if level is not None:
                close(number)
                if not is_project_header(line):
                    path = {k: x for k, x in path.items() if k < level} | {level: line}
                continue
            if len(block) >= 2 and is_new_item(line) and is_project(block[0]):
                close(number)
            if block:
                block.append(line)
                if len(block) < 14 and len("\n".join(block)) < 1700:
                    continue
                close(number)
            if not is_project_header(line):
                block.append(line)
        close(number)
    return once(out)


def decision(pages: list[list[str]]) -> list[dict]:
    """Legal basis, front matter, articles and the closing part; long ones are split."""
    out: list[dict] = []
    kind, heading, body, page = "front_matter", None, [], 1

    def flush() -> None:
        text = "\n".join(body).strip()
        if text:
            for part in split_text(text, DECISION_MOST, 120) if len(text) > DECISION_MOST else [text]:
                out.append(chunk(part, page, kind, "decision", section_heading=heading))

    for number, lines in enumerate(pages, 1):
        for line in lines:
            f = flat(line)
            next_ = ("article", line.strip()) if re.match(r"dieu\s+\d+\b", f) else ("legal_basis", None) if f.startswith("can cu") and kind != "article" else ("closing", None) if f.startswith("noi nhan") else None
            if next_ and not (next_[0] == kind == "legal_basis"):
                flush()
                (kind, heading), body, page = next_, [], number
            body.append(line)
    flush()
    return once(out)


def sections(pages: list[list[str]]) -> list[dict]:
    """Sections under headings and tables of four rows; where nothing is found, each page is split."""
    out: list[dict] = []
    for number, lines in enumerate(pages, 1):
        blocks: list[tuple[str, list[str]]] = []
        for line in lines:
            kind = "table" if is_table(line) else "text"
            if not blocks or blocks[-1][0] != kind or (kind == "text" and is_heading(line)):
                blocks.append((kind, []))
            blocks[-1][1].append(line)
        for kind, own in blocks:
            heading = own[0].strip() if kind == "text" and is_heading(own[0]) else None
            if kind == "table":
                head = [x for x in own[:2] if not re.search(r"\d", x)]
                rows = own[len(head) :] or own
                parts = ["\n".join([*head, *rows[i : i + TABLE_ROWS]]) for i in range(0, len(rows), TABLE_ROWS)]
                parts = [q for p in parts for q in (split_text(p, TABLE_MOST, 120) if len(p) > TABLE_MOST else [p])]
            else:
                text = "\n".join(own).strip()
                parts = split_text(text, SECTION_MOST, 120) if len(text) > SECTION_MOST else [text]
                parts = [p if i == 0 or not heading else f"{heading}\n{p}" for i, p in enumerate(parts)]
            out += [chunk(p, number, kind, "section", section_heading=heading) for p in parts if p.strip()]
    if not out:
        out = [chunk(p, n, "text", "page") for n, lines in enumerate(pages, 1) for p in split_text("\n".join(lines), *SIZES["planning"])]
    return once(out)


def once(chunks: list[dict]) -> list[dict]:
    """K1g: the first of equal content, page and type."""
    return list({(flat(c["content"]), c["page_number"], c["chunk_type"]): c for c in reversed(chunks)}.values())[::-1]


def continued(chunks: list[dict]) -> list[dict]:
    """A text that goes on from the merged one before it is joined to it."""
    out: list[dict] = []
    for c in chunks:
        p = out[-1] if out else None
        near = p is not None and p["chunk_type"] == c["chunk_type"] == "text" and any(p[k] and p[k] == c[k] for k in ("page_number", "section_heading", "hierarchy_path"))
        if near:
            end, start = flat(p["content"].split("\n")[-1]), flat(c["content"].split("\n")[0])
            short = len(c["content"]) <= 260 or c["content"].count("\n") < 4
            if end.endswith(":") or re.search(r"\b(?:gom|la|dat|va|cua|tai|cu the)$", end) or re.search(LEADS, start) or (short and re.search(UNIT, flat(c["content"])) and not re.search(UNIT, flat(p["content"]))):
                out[-1] = p | {"content": p["content"] + "\n" + c["content"]}
                continue
        out.append(c)
    return out


class Locator:
    """The page and lines that a chunk stands on; each page's search goes on from where the last one ended."""

    def __init__(self, pages: list[list[str]]):
        self.pages = [[flat(x) for x in lines] for lines in pages]
        self.cursor = [0] * len(pages)

    def find(self, content: str, page: int) -> tuple[int, int, int] | None:
        """The first window of at most 25 lines that holds 0.92 of the chunk's words, its own page before the others;
        else the one that holds most, if these are 0.35."""
        words = Counter(flat(content).split())
        total = sum(words.values())
        best, place = 0.0, None
        for p in sorted(range(len(self.pages)), key=lambda p: p != page - 1) if total else ():
            lines = self.pages[p]
            held: dict[int, list[str]] = {}
            for s in range(min(self.cursor[p], len(lines) - 1), len(lines)) if lines else ():
                seen: set[str] = set()
                score = 0
                for e in range(s, min(len(lines), s + 25)):
                    if e not in held:  # words hold no blank, so a window holds one only within a line
                        held[e] = [w for w in words if w in lines[e]]
                    for w in held[e]:
                        if w not in seen:
                            seen.add(w)
                            score += words[w]
                    if score > best * total:
                        best, place = score / total, (p, s, e)
                    if score >= 0.92 * total:
                        return self.ended(p, s, e)
        return self.ended(*place) if place and best >= 0.35 else None

    def ended(self, p: int, s: int, e: int) -> tuple[int, int, int]:
        self.cursor[p] = min(e + 1, len(self.pages[p]) - 1)
        return p + 1, s + 1, e + 1


#: Other names of the chunking modes.
MODES = {"": "hierarchical_parent_context", "parent_context": "hierarchical_parent_context", "parent_child": "hierarchical_parent_child", "fixed": "baseline_fixed", "baseline": "baseline_fixed", "structured": "structure_aware"}


def document_chunks(text: str, mode: str = "") -> list[dict]:
    """The mode's chunks of a document (pages are parted by form feeds), weak ones left out, with their lines."""
    mode = MODES.get(mode.strip().lower(), mode)
    pages = [[x for x in p.split("\n") if x.strip()] for p in (text or "").split("\f")]
    if mode == "baseline_fixed":
        chunks = [chunk(p, n, "text", "fixed") for n, lines in enumerate(pages, 1) for p in split_text("\n".join(lines), *SIZES["planning"])]
    elif mode.startswith("hierarchical"):
        chunks = hierarchical(pages, mode.removeprefix("hierarchical_"))
        chunks = chunks or sections(pages)
    else:
        kind = archetype([x for p in pages for x in p])
        ways = {"decision": (decision, sections), "hierarchical_table": (contextual, sections)}.get(kind, (sections, contextual))
        chunks = continued(next((found for way in ways if (found := way(pages))), []))
    chunks = [c for c in chunks if c["is_parent"] or not is_weak(c["content"])]
    locator, counts = Locator(pages), {}
    for i, c in enumerate(chunks, 1):
        counts[c["chunk_type"]] = counts.get(c["chunk_type"], -1) + 1
        span = None if c["is_parent"] else locator.find(re.sub(r"^\[h.*\]\n", "", c["content"], flags=re.M), c["page_number"])
        c |= {"page_number": span[0] if span else c["page_number"], "line_start": span and span[1], "line_end": span and span[2]}
        c |= {"chunk_index": counts[c["chunk_type"]], "global_index": i, "preview": c["content"][:400]}
    return chunks


SCHEMA = "content string, chunk_type string, page_number int, chunker string, section_heading string, hierarchy_path string, hierarchy_level int, parent_chunk_id string, is_parent boolean, chunk_index int, global_index int, line_start int, line_end int, preview string"


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mode: str = "") -> DataFrame:
    """The chunks of every document; a row never leaves its task."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *(c[n] for n in names)) for i, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) for c in document_chunks(t, mode)]
            out = pd.DataFrame(rows, columns=[doc_id, *names])
            for n in ("hierarchy_level", "line_start", "line_end"):
                out[n] = out[n].astype("Int32")
            yield out

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInPandas(run, f"{doc_id} {kind}, {SCHEMA}")


def text_slices(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """The rows (id, text) of a batch, a bounded number of characters at a time, so that only these are Python objects."""
    rows, size = [], 0
    for n in range(batch.num_rows):
        rows.append((batch.column(0)[n].as_py(), batch.column(1)[n].as_py()))
        size += len(rows[-1][1] or "")
        if size >= SLICE:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def split_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", profile: str = "default") -> DataFrame:
    """T1 over a table: piece from 0, content."""
    size = SIZES[profile]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                pieces = [(i, n, p) for i, t in rows for n, p in enumerate(split_text(t or "", *size))]
                columns = list(zip(*pieces, strict=True)) or [(), (), ()]
                kinds = (batch.schema.field(0).type, pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [doc_id, "piece", "content"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, piece int, content string")
