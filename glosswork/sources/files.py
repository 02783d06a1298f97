"""Files of a folder as listings and as segments.

Listings prune the content (the binary reader then reads no bytes). Parsers give the segment stream of a document: doc_id,
seg_index, text, kind, page, section, font_colors; a file that can't be parsed gives one row of kind "error" with the reason,
and never stops the job. Empty files have no segments.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.session import cut_lineage

EXTENSIONS = ("docx", "pdf", "xlsx", "txt", "md")
# Extensions that no upload may have.
DENIED = ("exe", "bat", "cmd", "ps1", "psm1", "msi", "dll", "js", "jse", "vbs", "vbe", "com", "scr", "cpl", "jar", "hta", "lnk", "reg", "sh", "php", "phar", "py", "wsf", "msc", "pif")
MAX_DEPTH, MAX_FILES, MAX_BYTES = 12, 20_000, 512 * 1024 * 1024
SEGMENT = "path string, seg_index int, text string, kind string, page int, section string, font_colors array<string>"
LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}]"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, max_depth: int = MAX_DEPTH, max_files: int = MAX_FILES) -> DataFrame:
    """item_id, relative_path, file_name, extension, size, modified, etag, is_remote of the files under `root`.

    Temporary and hidden files are left out. `max_files` is the feature's cap on what one scan yields, in path order.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = root.removeprefix("file:").rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    rows = raw.select(
        relative.alias("relative_path"), F.substring_index("path", "/", -1).alias("file_name"), extension(F.col("path")).alias("extension"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(None).cast("string").alias("etag"), F.lit(False).alias("is_remote"),
    )
    hidden = F.col("file_name").rlike(r"^(~\$|\.~|\._)")
    deep = F.size(F.split("relative_path", "/")) - 1 > max_depth
    rows = rows.filter(F.col("extension").isin(*extensions) & ~hidden & ~deep)
    return rows.select(F.sha2(F.lower("relative_path"), 256).alias("item_id"), "*").orderBy("relative_path").limit(max_files)


def remote_listing(pages: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Files of a dumped remote listing: rows folder_id, value array<struct<id,name,size,cTag,eTag,folder,file,modified>>.

    Folders are walked from folder_id "root" down, one join a level; the change token is cTag, else eTag.
    """
    items = pages.select("folder_id", F.explode("value").alias("v")).select("folder_id", "v.*").dropDuplicates(["folder_id", "id"])
    level = items.filter("folder_id = 'root'").withColumn("relative_path", F.col("name"))
    levels = [level]
    for _ in range(max_depth):
        folders = level.filter(F.col("folder").isNotNull()).select(F.col("id").alias("folder_id"), F.col("relative_path").alias("parent"))
        # written once, so a level is not made again from the root for every level under it
        level = cut_lineage(items.join(folders, "folder_id").withColumn("relative_path", F.concat_ws("/", "parent", "name")).drop("parent"))
        if level.isEmpty():
            break
        levels.append(level)
    files = reduce(DataFrame.unionByName, levels).filter(F.col("folder").isNull())
    return files.select(
        F.col("id").alias("item_id"), "relative_path", F.col("name").alias("file_name"), extension(F.col("name")).alias("extension"), "size",
        "modified", F.coalesce("cTag", "eTag").alias("etag"), F.lit(True).alias("is_remote"),
    )


def upload_check(files: DataFrame, max_kilobytes: int = 65_536, members: bool = False) -> DataFrame:
    """file_name, accepted, reason of files (file_name, content): refused by deny list, allow list, size, or leading bytes; with
    `members` also archives without the part that makes them a document or a workbook (its name stands in the archive as it is),
    and texts with a zero byte."""
    ext, head = extension(F.col("file_name")), F.hex(F.substring("content", 1, 5))
    office, pdf = F.lit("504B0304"), F.lit("255044462D")
    reason = (
        F.when(ext.isin(*DENIED), "denied extension")
        .when(~ext.isin(*EXTENSIONS) | (ext == ""), "unknown extension")
        .when(F.octet_length("content") > max_kilobytes * 1024, "too large")
        .when(F.octet_length("content") == 0, "empty")
        .when((ext == "pdf") & (head != pdf), "not a PDF")
        .when(ext.isin("docx", "xlsx") & ~F.startswith(head, office), "not an archive")
    )
    if members:
        lacks = lambda part: ~F.contains(F.col("content"), F.lit(bytearray(part)))
        reason = F.coalesce(reason, F.when((ext == "docx") & lacks(b"word/document.xml"), "not a document").when((ext == "xlsx") & lacks(b"xl/workbook.xml"), "not a workbook").when((ext == "txt") & ~lacks(b"\x00"), "not a text"))
    return files.select("file_name", reason.isNull().alias("accepted"), reason.alias("reason"))


def decode(content: bytes) -> tuple[str, str]:
    """Text and its encoding: byte order mark, else the first encoding that reads all of it."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace"), name
    for name in ("utf-8", "utf-16", "gb18030", "big5", "cp1252"):
        try:
            return content.decode(name), name
        except (UnicodeDecodeError, UnicodeError):
            continue
    return content.decode("latin-1"), "latin-1"


def _docx(content: bytes) -> Iterator[tuple]:
    archive = zipfile.ZipFile(io.BytesIO(content))
    body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    section: str | None = None

    def text_of(node) -> str:  # noqa: ANN001
        return "".join(t.text or "" if t.tag == f"{W}t" else "\t" for t in node.iter() if t.tag in (f"{W}t", f"{W}tab")).strip()

    def colours(node) -> list[str]:  # noqa: ANN001
        return sorted({c.get(f"{W}val", "").upper() for c in node.iter(f"{W}color")} - {"", "AUTO"})

    for node in body if body is not None else ():
        if node.tag == f"{W}p":
            text = text_of(node)
            style = node.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val", "") if style is not None else ""
            heading = name.startswith("Heading") or name in ("Title", "Subtitle")
            if text:
                section = text if heading else section
                yield text, "heading" if heading else "paragraph", None, section, colours(node)
        elif node.tag == f"{W}tbl":
            for cell in node.iter(f"{W}tc"):
                if text := text_of(cell):
                    yield text, "table_cell", None, section, colours(cell)
    for kind in ("header", "footer"):
        for name in sorted(n for n in archive.namelist() if n.startswith(f"word/{kind}") and n.endswith(".xml")):
            for p in ElementTree.fromstring(archive.read(name)).iter(f"{W}p"):
                if text := text_of(p):
                    yield text, kind, None, None, colours(p)


def _xlsx(content: bytes, cap: int = 500_000) -> Iterator[tuple]:
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = set(archive.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{S}si")]
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    cells = 0
    for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{S}sheet"):
        target = targets.get(sheet.get(f"{R}id"), "").lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        for c in ElementTree.fromstring(archive.read(path)).iter(f"{S}c") if path in names else ():
            cells += 1
            if cells >= cap:
                yield f"the sheet has more than {cap} cells; the rest was left out", "note", None, sheet.get("name"), []
                return
            value = c.find(f"{S}v")
            if c.get("t") == "s" and value is not None:
                text = shared[int(value.text)].strip()
            elif c.get("t") == "str" and value is not None:  # the text that a formula gave
                text = (value.text or "").strip()
            elif c.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{S}t")).strip()
            else:
                continue
            if text:
                yield text, "sheet_cell", None, sheet.get("name"), []


def _txt(content: bytes) -> Iterator[tuple]:
    for line in decode(content)[0].lstrip("﻿").splitlines():
        if line.strip():
            yield line.strip(), "line", None, None, []


#: extension -> parser of a file's bytes; others may be added
PARSERS = {"docx": _docx, "xlsx": _xlsx, "txt": _txt, "text": _txt, "md": _txt}


def parse(files: DataFrame) -> DataFrame:
    """Segments of files (path, content); unknown kinds of file, and files over MAX_BYTES, give an error row. Rows of kind
    "note" say what was left out or guessed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                parser = PARSERS.get(path.rpartition(".")[2].lower())
                try:
                    if len(content) > MAX_BYTES:
                        raise ValueError("larger than the limit")
                    rows = list(parser(bytes(content))) if parser else [("unsupported format", "error", None, None, [])]
                except Exception as e:  # a broken file is a row, not a failure
                    rows = [(f"{type(e).__name__}: {e}", "error", None, None, [])]
                out = pd.DataFrame(rows, columns=["text", "kind", "page", "section", "font_colors"])
                out.insert(0, "path", path)
                out.insert(1, "seg_index", range(len(out)))
                yield out.astype({"page": "Int32"})

    return files.filter(F.octet_length("content") > 0).select("path", "content").mapInPandas(run, SEGMENT)


def text_lines(documents: DataFrame) -> DataFrame:
    """doc_id, seg_index, text: the lines of documents' texts, blank ones left out; every kind of line break counts."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", LINE_BREAKS)).alias("seg_index", "line"))
    return lines.select("doc_id", "seg_index", F.trim("line").alias("text")).filter(F.col("text") != "")


def with_scanned_text(pages: DataFrame, scanned: DataFrame) -> DataFrame:
    """doc_id, page, text, recovered: pages (doc_id, page, text) whose missing or blank text is taken from scanned pages."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    own = scanned.dropDuplicates(["doc_id", "page"]).select("doc_id", "page", F.col("text").alias("scan"))
    rows = pages.join(own, ["doc_id", "page"], "left")
    return rows.select("doc_id", "page", F.when(blank, F.col("scan")).otherwise(F.col("text")).alias("text"), (blank & F.col("scan").isNotNull()).alias("recovered"))
