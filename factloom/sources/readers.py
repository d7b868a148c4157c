"""Sources: files, archives, sitemaps, golden suites."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of files that are taken from archives and folders.
SUFFIXES = (".pdf", ".docx", ".pptx", ".xlsx", ".txt", ".md", ".csv", ".json", ".html", ".htm", ".xml", ".log")
MAX_FILES, MAX_BYTES, SHEET_ROWS = 100, 100 << 20, 200


class SourceNotConfiguredError(RuntimeError):
    """A source that is planned but can't be read."""


class NoFilesError(RuntimeError):
    """A source that gave no file."""


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of the files of a folder, whatever its depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def expanded(uploads: DataFrame) -> DataFrame:
    """filename, appears_at, content of uploads (filename, content): archives give their members, other files themselves.

    Folders, dot files and resource forks are left out; members' slashes become ``__``; files over the limit go.
    """

    def run(batches):
        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name.lower().endswith(".zip"):
                    out.append((name, f"upload://{name}", raw))
                    continue
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    members = [m for m in z.infolist() if not m.is_dir() and "__MACOSX" not in m.filename and not m.filename.rsplit("/", 1)[-1].startswith(".") and m.filename.lower().endswith(SUFFIXES)]
                    out += [(m.filename.replace("/", "__"), f"upload://{name}/{m.filename}", z.read(m)) for m in members[:MAX_FILES] if m.file_size <= MAX_BYTES]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], ["filename", "appears_at", "content"])

    return uploads.select("filename", "content").mapInArrow(run, "filename string, appears_at string, content binary")


def left_out(uploads: DataFrame) -> DataFrame:
    """filename, member, reason of what ``expanded`` doesn't take from archives: beyond the number of files, too large, or of no known kind."""

    def run(batches):
        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name.lower().endswith(".zip"):
                    continue
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    shown = [m for m in z.infolist() if not m.is_dir() and "__MACOSX" not in m.filename and not m.filename.rsplit("/", 1)[-1].startswith(".")]
                    known = [m for m in shown if m.filename.lower().endswith(SUFFIXES)]
                    out += [(name, m.filename, "kind") for m in shown if m not in known]
                    out += [(name, m.filename, "count") for m in known[MAX_FILES:]]
                    out += [(name, m.filename, "size") for m in known[:MAX_FILES] if m.file_size > MAX_BYTES]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["filename", "member", "reason"])

    return uploads.select("filename", "content").mapInArrow(run, "filename string, member string, reason string")


def _words(xml: str, tag: str) -> str:
    """The text of all elements of a kind, put together; tabs and breaks count as blanks and lines."""
    marked = re.sub(r"<w:tab\b[^>]*/>", "\t", re.sub(r"<(?:w|a):br\b[^>]*/>", f"<{tag}>\n</{tag}>", xml))
    return html.unescape("".join(re.findall(rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", marked)))


def _office_text(name: str, raw: bytes) -> str | None:
    """The text of a .docx, .pptx or .xlsx file, whose parts are XML; None for other files and broken ones."""
    kind = name.lower().rsplit(".", 1)[-1]
    if kind not in ("docx", "pptx", "xlsx"):
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            part = lambda p: z.read(p).decode("utf-8", "replace") if p in z.namelist() else ""
            numbered = lambda pattern: sorted((p for p in z.namelist() if re.fullmatch(pattern, p)), key=lambda p: int(re.findall(r"\d+", p)[-1]))
            if kind == "docx":
                lines = (_words(p, "w:t") for p in re.findall(r"(?s)<w:p\b.*?</w:p>", part("word/document.xml")))
                return "\n".join(x for x in lines if x.strip())
            if kind == "pptx":
                return "\n\n".join("\n".join("\n".join(_words(p, "a:t") for p in re.findall(r"(?s)<a:p\b.*?</a:p>", shape)) for shape in re.findall(r"(?s)<p:txBody\b.*?</p:txBody>", part(s))) for s in numbered(r"ppt/slides/slide\d+\.xml"))
            shared = [_words(x, "t") for x in re.findall(r"(?s)<si\b.*?</si>", part("xl/sharedStrings.xml"))]
            titles = [html.unescape(t) for t in re.findall(r"<sheet\b[^>]*\bname=\"([^\"]*)\"", part("xl/workbook.xml"))]
            out = []
            for title, sheet in zip(titles, numbered(r"xl/worksheets/sheet\d+\.xml"), strict=False):
                rows = []
                for row in re.findall(r"(?s)<row\b.*?</row>", part(sheet)):
                    cells = []
                    for attributes, body in re.findall(r"(?s)<c\b([^>]*)>(.*?)</c>", row):
                        v = _words(body, "v") or _words(body, "t")
                        cells.append(shared[int(v)] if 't="s"' in attributes and v else v)
                    if any(cells):
                        rows.append(" | ".join(c for c in cells if c))
                out.append(f"# Sheet {title}\n" + "\n".join(rows[:SHEET_ROWS]))
            return "\n\n".join(out)
    except (zipfile.BadZipFile, ValueError, IndexError, KeyError):
        return None


def office_texts(found: DataFrame) -> DataFrame:
    """filename, text of office files (filename, content); null for files of other kinds and broken ones."""

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_office_text(n, r or b"") for n, r in zip(names, batch.column(1).to_pylist(), strict=True)], pa.string())], ["filename", "text"])

    return found.select("filename", "content").mapInArrow(run, "filename string, text string")


def landed(found: DataFrame) -> DataFrame:
    """Files of a source with text and hashes, ready to be stored; none is an error."""
    if found.isEmpty():
        raise NoFilesError("NO_FILES")
    return texts(found)


def texts(raw: DataFrame) -> DataFrame:
    """Files with ``text``, invalid bytes left out, and hashes of bytes and stripped text."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    return raw.withColumns({"text": text, "binary_hash": F.sha2("content", 256), "text_hash": F.sha2(stripped, 256)})


def sitemap_urls(xml: DataFrame) -> DataFrame:
    """source, url of sitemaps (source, xml)."""
    return xml.select("source", F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))


def seeded_urls(stored: DataFrame) -> DataFrame:
    """host, url of pages that stored robots and sitemap files (url, text) lead to.

    robots.txt names sitemaps beside the usual ones, a sitemap of sitemaps names others of its host; pages are those
    of the same host, without query and fragment, each once.
    """
    host = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"^https?://([^/?#]*)", 1)), r"^www\.", "")
    files_ = stored.select("url", "text", host(F.col("url")).alias("host"))
    robots = files_.where("url LIKE '%/robots.txt'").select("host", F.explode(F.regexp_extract_all("text", F.lit(r"(?im)^sitemap:\s*(\S+)"), F.lit(1))).alias("url"))
    usual = files_.where(F.col("url").rlike(r"^https?://[^/]+/sitemap(_index|-index)?\.xml$")).select("host", "url")
    maps = files_.select("url", "text")
    told = robots.union(usual).distinct().join(maps, "url").select("host", F.explode(F.regexp_extract_all("text", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))
    nested = told.where(F.col("url").endswith(".xml") & (host(F.col("url")) == F.col("host"))).distinct().join(maps, "url").select("host", F.explode(F.regexp_extract_all("text", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))
    pages = told.union(nested).where(~F.col("url").endswith(".xml") & (host(F.col("url")) == F.col("host")))
    return pages.select("host", F.regexp_replace("url", r"[?#].*$", "").alias("url")).distinct()


def sample(spark: SparkSession, path: str) -> DataFrame:
    """filename, content of a bundled folder of text files, by name."""
    found = files(spark, path).where(F.lower("path").rlike(r"\.(txt|md)$"))
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content").orderBy("filename")


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of the best suite of each agent: most cases first, then suite_id; files that start with _ are left out."""
    suites = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[!_]*.json").json(path)
    best = Window.partitionBy("agent_name").orderBy(F.desc(F.size("cases")), F.desc("suite_id"))
    one = suites.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return one.select("suite_id", "agent_name", F.explode("cases").alias("case")).select("suite_id", "agent_name", "case.*")


#: Kinds of sources and their readers, and kinds that are planned only. Libraries and blob containers are read through the path Spark sees them by.
CONNECTORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"files": files, "sample": sample, "sharepoint": files, "blob": files}
PLANNED = ("confluence", "jira", "slack", "notion", "gdrive", "s3", "email")


def register(kind: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Add a kind of source, or replace its reader."""
    CONNECTORS[kind] = reader


def connector(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    if kind not in CONNECTORS:
        raise SourceNotConfiguredError(f"{kind} is planned" if kind in PLANNED else f"{kind} isn't known; there are {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[kind]
