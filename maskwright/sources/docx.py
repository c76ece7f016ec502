"""Word documents: a reader of paragraphs with their runs, and a writer of redacted copies.

Only the standard library opens the files. One row per paragraph, in reading order: body,
then tables, then each section's header and footer. A paragraph that is met again (merged
cells, shared headers) keeps its element_id, so blocks.once() can leave repeats out.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = "file string, block_seq int, container string, path string, element_id string, runs array<string>"


def _runs(paragraph: ElementTree.Element) -> list[ElementTree.Element]:
    """Runs of a paragraph, those inside links too."""
    out = []
    for child in paragraph:
        if child.tag == f"{_W}r":
            out.append(child)
        elif child.tag == f"{_W}hyperlink":
            out += [r for r in child if r.tag == f"{_W}r"]
    return out


def _text(run: ElementTree.Element) -> str:
    parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n", f"{_W}noBreakHyphen": lambda e: "-"}
    return "".join(parts[e.tag](e) for e in run if e.tag in parts)


def _section_parts(archive: zipfile.ZipFile, body: ElementTree.Element) -> list[tuple[int, str, str]]:
    """(section, header or footer, name of the part)."""
    try:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("word/_rels/document.xml.rels"))}
    except KeyError:
        return []
    out = []
    for n, section in enumerate(body.iter(f"{_W}sectPr")):
        for kind in ("header", "footer"):
            for ref in section.findall(f"{_W}{kind}Reference"):
                if ref.get(f"{_W}type", "default") == "default" and links.get(ref.get(f"{_R}id")):
                    out.append((n, kind, "word/" + links[ref.get(f"{_R}id")].lstrip("/").removeprefix("word/")))
    return out


def _walk(archive: zipfile.ZipFile) -> Iterator[tuple[str, str, str, ElementTree.Element, ElementTree.Element]]:
    """(container, path, element id, paragraph, tree of its part)."""
    main = ElementTree.fromstring(archive.read("word/document.xml"))
    body = main.find(f"{_W}body")
    for i, p in enumerate(body.findall(f"{_W}p")):
        yield "body", f"body / paragraph={i}", f"word/document.xml#b{i}", p, main
    for t, table in enumerate(body.findall(f"{_W}tbl")):
        for r, row in enumerate(table.findall(f"{_W}tr")):
            for c, cell in enumerate(row.findall(f"{_W}tc")):
                for i, p in enumerate(cell.findall(f"{_W}p")):
                    yield "table", f"table / table={t} / row={r} / cell={c} / paragraph={i}", f"word/document.xml#t{t}.{r}.{c}.{i}", p, main
    trees: dict[str, ElementTree.Element] = {}
    for section, kind, name in _section_parts(archive, body):
        if name not in trees:
            trees[name] = ElementTree.fromstring(archive.read(name))
        for i, p in enumerate(trees[name].findall(f"{_W}p")):
            yield kind, f"{kind} / section={section} / paragraph={i}", f"{name}#{i}", p, trees[name]


def paragraphs(data: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return [{"block_seq": n, "container": c, "path": path, "element_id": e, "runs": [_text(r) for r in _runs(p)]} for n, (c, path, e, p, _) in enumerate(_walk(archive))]


def read(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA for each paragraph of the .docx files under path, on any store that Spark reads."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rows = [{"file": name} | p for p in paragraphs(data)]
                if rows:
                    yield pd.DataFrame(rows)[["file", "block_seq", "container", "path", "element_id", "runs"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(run, SCHEMA)


def rewritten(data: bytes, texts: dict[str, list[str]]) -> bytes:
    """A copy with new texts of runs, by element id; everything else stays as it is."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        changed: dict[str, ElementTree.Element] = {}
        for _, _, element, paragraph, tree in _walk(archive):
            if element not in texts:
                continue
            for run, new in zip(_runs(paragraph), texts[element], strict=True):
                if _text(run) == new:
                    continue
                for e in [e for e in run if e.tag != f"{_W}rPr"]:
                    run.remove(e)
                t = ElementTree.SubElement(run, f"{_W}t")
                t.text = new
                t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            changed[element.partition("#")[0]] = tree
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
            for item in archive.infolist():
                target.writestr(item, ElementTree.tostring(changed[item.filename], encoding="UTF-8", xml_declaration=True) if item.filename in changed else archive.read(item.filename))
    return out.getvalue()


def write(data: bytes, path: str) -> None:
    """Puts data at path whole or not at all; a file that cannot be read again is not put there."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(suffix=".docx", dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        with open(temporary, "rb") as f:
            paragraphs(f.read())
        os.replace(temporary, path)
    except Exception as e:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise RuntimeError(f"could not write {path}: {e}") from e
