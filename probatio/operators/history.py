"""What changed between the saves of a file: texts, objects and tools of its versions.

A version is the file up to an end marker. All versions of a file are read where the file is, one after the other,
each from where the last one ends, and nothing but the findings leaves the task.
"""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import dims
from probatio.operators.structure import object_kind
from probatio.sources.pdf import Pdf
from probatio.sources.spread import each

_END = re.compile(rb"%%EOF[\r\n]*")
CHANGED = "array<struct<page:int,removed:array<string>,added:array<string>>>"
OBJECTS = "array<struct<xref:int,page:int,old:string,new:string>>"
VERSION = "struct<version:int,pages:array<string>>"
STEP = f"struct<from_version:int,to_version:int,from_tool:string,to_tool:string,changes:{CHANGED},object_changes:{OBJECTS}>"


def versions(data: bytes) -> list[Pdf]:
    """The file as it was after each save; each is read from where the one before it ends."""
    out: list[Pdf] = []
    for m in _END.finditer(data):
        out.append(Pdf(data[: m.end()], out[-1] if out else None))
    return out


def tool(pdf: Pdf) -> str:
    """What made a version, and the editor that its toolkit gives away where the producer does not name it."""
    info = pdf.metadata()
    base = info.get("producer") or info.get("creator") or "Unknown"
    found = re.search(r'x:xmptk="([^"]+)"', pdf.xmp())
    low = found[1].lower() if found else ""
    editor = next((name for mark, name in dims.TOOLKIT_EDITORS if mark in low), None)
    if editor is None or editor.lower().split(" ")[0] in info.get("producer", "").lower():
        return base
    return f"{base} → modified with {editor}"


def changed_lines(old: str, new: str) -> tuple[list[str], list[str]]:
    """Lines removed and added, white space inside a line aside; blank lines do not count."""
    before, after = ([x for x in text.splitlines() if x.strip()] for text in (old, new))
    plain = [[" ".join(x.split()) for x in lines] for lines in (before, after)]
    removed: list[str] = []
    added: list[str] = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, *plain).get_opcodes():
        if kind != "equal":
            removed += before[i:j]
            added += after[k:m]
    return removed, added


def page_changes(old: list[str], new: list[str]) -> list[dict]:
    """Pages, from 1, whose lines differ; a page that one side lacks counts as empty."""
    out = []
    for i in range(max(len(old), len(new))):
        a, b = (pages[i].strip() if i < len(pages) else "" for pages in (old, new))
        removed, added = changed_lines(a, b) if a != b else ([], [])
        if removed or added:
            out.append({"page": i + 1, "removed": removed, "added": added})
    return out


def object_changes(old: Pdf, new: Pdf) -> list[dict]:
    """Objects whose text (of a stream: its dictionary) differs, with the page that shows their stream in either version."""
    shown = old.page_contents() | new.page_contents()
    numbers = sorted(old.objects.keys() | new.objects.keys())
    texts = [(n, old.object_text(n), new.object_text(n)) for n in numbers]
    return [{"xref": n, "page": shown.get(n), "old": a, "new": b} for n, a, b in texts if a != b]


def steps(data: bytes) -> list[dict]:
    """Every pair of neighbouring versions; pairs with a version without pages (a stub) have no changes."""
    read = versions(data)
    texts = [pdf.text() for pdf in read]
    out = []
    for i in range(len(read) - 1):
        old, new = read[i], read[i + 1]
        stub = not texts[i] or not texts[i + 1]
        out.append({
            "from_version": i + 1, "to_version": i + 2, "from_tool": None if stub else tool(old), "to_tool": None if stub else tool(new),
            "changes": [] if stub else page_changes(texts[i], texts[i + 1]), "object_changes": [] if stub else object_changes(old, new),
        })
    return out


def _by_file(kind: str, find) -> Column:
    return each(lambda data: find(data) if data else [], f"array<{kind}>", F.col("content"))


def version_texts(files: DataFrame) -> DataFrame:
    """doc_id, version, page, text of each page of each version of ``files`` (doc_id, content); stubs have no rows."""
    found = files.select("doc_id", F.explode(_by_file(VERSION, lambda data: [{"version": i + 1, "pages": pdf.text()} for i, pdf in enumerate(versions(data))])).alias("v"))
    pages = found.select("doc_id", "v.version", F.posexplode("v.pages").alias("page", "text"))
    return pages.select("doc_id", F.col("version").cast("long"), (F.col("page") + 1).cast("long").alias("page"), "text")


def history(files: DataFrame) -> DataFrame:
    """doc_id, version_count, from_version, to_version, from_tool, to_tool, changes, object_changes.

    One row for each save after the first; a file saved once has none. ``object_changes`` says what kind each is.
    """
    kind = lambda o: object_kind(F.when(o["new"] != "", o["new"]).otherwise(o["old"]), o["page"])
    typed = F.transform("s.object_changes", lambda o: F.struct(o["xref"].alias("xref"), o["page"].alias("page"), kind(o).alias("type")))
    found = files.select("doc_id", _by_file(STEP, steps).alias("steps")).where(F.size("steps") > 0)
    rows = found.select("doc_id", (F.size("steps") + 1).alias("version_count"), F.explode("steps").alias("s"))
    return rows.select("doc_id", "version_count", "s.from_version", "s.to_version", "s.from_tool", "s.to_tool", "s.changes", typed.alias("object_changes"))


def object_kinds(found: DataFrame) -> DataFrame:
    """doc_id, type, n: how many objects of a kind a file's saves have changed."""
    kinds = found.select("doc_id", F.explode("object_changes").alias("o")).select("doc_id", "o.type")
    return kinds.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
