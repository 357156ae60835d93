"""Reading documents: binary files, HTML, JSON, DOCX and JSON lines.

Bytes come from Spark's binaryFile source, so any store Spark reads will do.  What
can't be read gives a row with its reason instead of an error.
"""

from __future__ import annotations

import html.parser
import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .pdf import PdfError, pdf_pages

# Extensions by way of reading.
PLAIN = ("txt", "md", "markdown", "csv", "tsv", "log", "rst", "")
LOSSY = ("pdf", "html")
ALLOWED = tuple(sorted({x for x in PLAIN if x} | {"json", "html", "htm", "pdf", "docx"}))
# Tags that begin a line, tags whose end begins one, tags whose content is not text.
BEGINS = frozenset("p br div li tr h1 h2 h3 h4 h5 h6".split())
ENDS = frozenset("p div li tr".split())
SKIPPED = frozenset("script style head noscript".split())
MOST_CHARS = 200_000


def _events(page: str) -> list[tuple[str, str]]:
    """("+", tag), ("-", tag) and ("", text) in the order of the page."""
    out: list[tuple[str, str]] = []
    parser = html.parser.HTMLParser(convert_charrefs=True)
    parser.handle_starttag = lambda tag, attrs: out.append(("+", tag))
    parser.handle_endtag = lambda tag: out.append(("-", tag))
    parser.handle_data = lambda data: out.append(("", data))
    parser.feed(page)
    parser.close()
    return out


def html_text(page: str) -> str:
    """Text outside scripts, styles and heads, with line ends around blocks; three or more line ends become two."""
    depth, out = 0, []
    for sign, x in _events(page):
        if not sign:
            out.append("" if depth else x)
        elif x in SKIPPED:
            depth = max(0, depth + (1 if sign == "+" else -1))
        elif x in (BEGINS if sign == "+" else ENDS):
            out.append("\n")
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def json_strings(text: str) -> str:
    """Every string value, depth first, one a line."""
    out, stack = [], [json.loads(text)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)
    return "\n".join(out)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs, then tables with their cells between tabs."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")

    def said(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    lines = [said(p) for p in body.findall(f"{_W}p")]
    lines += ["\t".join(said(c) for c in row.findall(f"{_W}tc")) for row in body.iter(f"{_W}tr")]
    return "\n".join(x for x in lines if x.strip())


def plain_text(data: bytes) -> str:
    for code in ("utf-8", "cp1250"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def base_name(path: str) -> str:
    """The file name of a path or URI."""
    return path.replace("\\", "/").rstrip("/").rpartition("/")[2]


def extract_one(data: bytes, name: str) -> tuple[str | None, str, str | None, int | None]:
    """(text, format, reason why there is no text, pages) of a file; name may be a path."""
    name = base_name(name).lower().strip()
    ext = name.rpartition(".")[2] if "." in name else ""
    if not data:
        return None, ext, "empty file", None
    pages = None
    try:
        if ext == "pdf" or data[:5] == b"%PDF-":
            found = pdf_pages(data)
            text, kind, pages = "\n\n".join(found), "pdf", len(found)
            if not text.strip():
                return None, "pdf", "no text: the pages may be scans", pages
        elif ext == "docx" or (data[:4] == b"PK\x03\x04" and ext not in PLAIN):
            text, kind = docx_text(data), "docx"
        elif ext in ("html", "htm"):
            text, kind = html_text(plain_text(data)), "html"
        elif ext == "json":
            text, kind = json_strings(plain_text(data)), "json"
        elif ext in PLAIN:
            text, kind = plain_text(data), "text"
        else:
            return None, ext, "unsupported file type", None
    except (ValueError, KeyError, AttributeError, TypeError, RecursionError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return None, ext, f"unreadable: {e if isinstance(e, PdfError) else type(e).__name__}", None
    return (text, kind, None, pages) if text.strip() else (None, kind, "no text", pages)


_EXTRACTED = StructType([StructField("text", StringType()), StructField("format", StringType()), StructField("reason", StringType()), StructField("pages", IntegerType())])


@F.pandas_udf(_EXTRACTED)
def _extract(data: pd.Series, name: pd.Series) -> pd.DataFrame:
    rows = [extract_one(bytes(d or b""), n or "") for d, n in zip(data, name, strict=True)]
    return pd.DataFrame(rows, columns=["text", "format", "reason", "pages"]).astype({"pages": "Int32"})


@F.pandas_udf(StringType())
def html_udf(s: pd.Series) -> pd.Series:
    return s.map(html_text, na_action="ignore")


@F.pandas_udf(StringType())
def json_udf(s: pd.Series) -> pd.Series:
    def read(text: str) -> str | None:
        try:
            return json_strings(text)
        except (ValueError, RecursionError):
            return None

    return s.map(read, na_action="ignore")


def extracted(files: DataFrame, content: str = "content", name: str = "path", most: int = MOST_CHARS) -> DataFrame:
    """files with text, format, pages, truncated, chars, notes and, where there is no text, reason."""
    df = files.withColumn("__e", _extract(F.col(content), F.col(name)))
    whole = F.col("__e.text")
    long = F.coalesce(F.length(whole) > most, F.lit(False))
    notes = F.filter(F.array(F.when(long, F.format_string("cut to %d of %d characters", F.lit(most), F.length(whole))), lossy_note(F.col("__e.format"))), lambda n: n.isNotNull())
    return df.withColumns({
        "text": F.left(whole, F.lit(most)), "format": F.col("__e.format"), "pages": F.col("__e.pages"), "truncated": long,
        "chars": F.least(F.length(whole), F.lit(most)), "notes": notes, "reason": F.col("__e.reason"),
    }).drop("__e")


def validated_uploads(files: DataFrame, name: str = "name", size: str = "size", most: int = 10_000_000) -> DataFrame:
    """files with a clean name, its extension, and the reason why an upload is refused."""
    clean = F.coalesce(clean_name(F.col(name)), F.lit("upload.txt"))
    ext = extension(F.col("clean_name"))
    return files.withColumn("clean_name", clean).withColumn("extension", ext).withColumn(
        "refused", F.when(~F.col("extension").isin(*ALLOWED), "unsupported file type").when(F.col(size) > most, "file too large").when(F.coalesce(F.col(size), F.lit(0)) == 0, "empty file")
    )


def read_files(spark: SparkSession, path: str, most: int = MOST_CHARS) -> DataFrame:
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), most=most).drop("content")


def lossy_note(source_format: Column) -> Column:
    return F.when(source_format.isin(*LOSSY), "the source format may have lost invisible characters")


def clean_name(name: Column) -> Column:
    """A file name without control characters, slashes as underscores, 200 characters at most; null where nothing is left."""
    clean = F.left(F.trim(F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1F\x7F]", ""), r"[/\\]", "_")), F.lit(200))
    return F.when(F.length(clean) > 0, clean)


def extension(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(name, r"\.([^.]*)$", 1)))


def read_corpus(spark: SparkSession, path: str, least_tokens: int = 40) -> DataFrame:
    """Labelled JSON lines (text, label, source): blank and // lines are skipped, texts below `least_tokens` dropped;
    another label than human or ai fails the query.  source defaults to the file name."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file")).where("v <> '' and v not like '//%'")
    row = lines.withColumn("r", F.from_json("v", "text string, label string, source string"))
    label = F.when(F.col("r.label").isin("human", "ai"), F.col("r.label")).otherwise(F.raise_error(F.concat(F.lit("label must be human or ai: "), F.col("v"))).cast("string"))
    return row.select(F.col("r.text").alias("text"), label.alias("label"), F.coalesce("r.source", "file").alias("source")).where(
        # the label is looked at first, for short texts too
        F.when(F.length("label") > 0, F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) >= least_tokens).otherwise(False)
    )


def write_by_workspace(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A folder for each workspace, as the object store had a prefix for each."""
    df.write.partitionBy("workspace_id").mode("append").format(fmt).save(path)


def has_prefix(files: DataFrame, prefix: str, name: str = "path") -> DataFrame:
    """At most one of the files below a prefix, the least by name."""
    return files.where(F.startswith(F.col(name), F.lit(prefix))).orderBy(name).limit(1)
