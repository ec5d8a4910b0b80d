"""Bibliographic exports and rating files as DataFrames."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.text import doi_url
from reviewlake.scale import cut_lineage, lookup

# The columns of a normalised record.
RECORD_COLUMNS = (
    "title",
    "abstract",
    "authors",
    "keywords",
    "source",
    "year",
    "doi",
    "url",
    "filename",
)
# Headers of the known export kinds and the columns they become.
WEB_OF_SCIENCE_HEADERS = {
    "Author Full Names": "authors",
    "Article Title": "title",
    "Source Title": "source",
    "Abstract": "abstract",
    "Author Keywords": "keywords",
    "Publication Year": "year",
    "DOI": "doi",
    "DOI Link": "url",
}
XPLORE_HEADERS = {
    "Document Title": "title",
    "Abstract": "abstract",
    "Author Keywords": "keywords",
    "Authors": "authors",
    "Publication Title": "source",
    "Publication Year": "year",
    "DOI": "doi",
    "PDF Link": "url",
}
# File stems and the export kind they stand for.
HEADERS_BY_STEM = {
    "xplore": XPLORE_HEADERS,
    "ieee": XPLORE_HEADERS,
    "wos": WEB_OF_SCIENCE_HEADERS,
}
MISSING = "N/A"
# Macros every BibTeX file may use: jan, feb, …
MONTHS = {name[:3].lower(): name for name in calendar.month_name if name}


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def normalise(df: DataFrame, mappings: Mapping[str, str] | None = None) -> DataFrame:
    """Project to the record columns: names mapped, year an int, links filled.

    A year that is no whole number stops the job, as does a missing column.
    """
    renamed = df.withColumnsRenamed(dict(mappings)) if mappings else df
    # A year may be written 2020 or 2020.0; null is not allowed.
    year = F.col("year").cast("string").cast("double")
    wrong = F.when(year.isNull(), "record without year").otherwise("record without a whole year")
    whole = F.coalesce(F.when(year == F.floor(year), year.cast("int")), F.raise_error(wrong).cast("int"))
    columns = {
        "year": whole,
        "doi": F.coalesce(F.col("doi").cast("string"), F.lit(MISSING)),
        "url": F.coalesce(F.col("url").cast("string"), F.lit(MISSING)),
    }
    return renamed.select(*[columns.get(c, F.col(c).cast("string")).alias(c) for c in RECORD_COLUMNS])


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    mappings: Mapping[str, str] | None = None,
    tabs: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Records of CSV or TSV exports, tagged with the stem of their file.

    Values may go over several lines, which makes a file one task; switch
    ``multi_line`` off for very large files without such values.
    """
    raw = spark.read.csv(
        path if isinstance(path, str) else list(path),
        header=True,
        sep="\t" if tabs else ",",
        multiLine=multi_line,
        quote='"',
        escape='"',
        encoding="utf-8",
    )
    return normalise(raw.withColumn("filename", file_stem(F.col("_metadata.file_path"))), mappings)


_HEAD = re.compile(r"\s*@\s*(\w+)\s*[{(]")
_KEY = re.compile(r"[^,={}()\"]*,")
_NAME = re.compile(r"[\s,]*([^\s=,{}()\"#]+)\s*=\s*")
_BARE = re.compile(r"[^\s,#{}()\"]+")
_JOIN = re.compile(r"\s*#\s*")
_MARKS = re.compile(r'[{}"]')
# Where an entry stands in its file: the start of the split, the row, the entry of the row.
_SPOT = "struct<split:bigint,row:bigint,at:int>"
_PARTS = "array<struct<name:string,macro:boolean,text:string>>"


def _entry_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kind of each BibTeX entry and the parts of its values."""
    for batch in batches:
        cut = [_scan(entry) for entry in batch["entry"]]
        yield pd.DataFrame(
            {
                "filename": batch["filename"],
                "spot": batch["spot"],
                "kind": [kind for kind, _ in cut],
                "parts": [parts for _, parts in cut],
            }
        )


def _delimited(text: str, at: int) -> tuple[str, int]:
    """The braced or quoted part that opens at a place, and the place behind it."""
    quoted, depth = text[at] == '"', 0
    for mark in _MARKS.finditer(text, at + 1):
        end = mark.start()
        if depth == 0 and mark.group() == ('"' if quoted else "}"):
            return text[at + 1 : end], end + 1
        depth += {"{": 1, "}": -1}.get(mark.group(), 0)
    return text[at + 1 :], len(text)


def _scan(entry: str) -> tuple[str, list[dict]]:
    """Kind and value parts ``(name, macro, text)``; the last value of a name stays."""
    head = _HEAD.match(entry)
    kind, at = head.group(1).lower(), head.end()
    key = None if kind == "string" else _KEY.match(entry, at)
    at = key.end() if key else at
    fields: dict[str, list[dict]] = {}
    while True:
        found = _NAME.match(entry, at)
        if not found:
            # Text that is no field ends at the next comma.
            at = entry.find(",", at) + 1
            if at == 0:
                break
            continue
        name, at = found.group(1).lower(), found.end()
        own = fields[name] = []
        while at < len(entry):
            bare = _BARE.match(entry, at)
            if bare:
                text, at = bare.group(), bare.end()
            elif entry[at] in '{"':
                text, at = _delimited(entry, at)
            else:
                break
            own.append({"name": name, "macro": bool(bare) and not text.isdigit(), "text": text})
            more = _JOIN.match(entry, at)
            if not more:
                break
            at = more.end()
    return kind, [part for own in fields.values() for part in own]


def _text_of(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def _with_macros(entries: DataFrame, macros: DataFrame) -> DataFrame:
    """Entries ``(id, filename, spot, parts)`` with the values of their macros filled in.

    ``macros (filename, macro, spot, value)`` are the definitions; a null value
    is one that is not known yet. The last definition before an entry is the one
    in force there. A name that has none is a month or stands for itself; a use
    of a value that is not known yet stays. Only the uses of macros move, and
    the definitions of one name in one file are one row. Spark knows no more of
    cut entries than the size of the files, which may be far smaller, so the
    joins are told not to broadcast them.
    """
    uses = (
        entries.select("id", "filename", "spot", F.explode(F.filter("parts", lambda p: p["macro"])).alias("p"))
        .select("id", "filename", "spot", F.lower("p.text").alias("macro"))
        .distinct()
    )
    counts = uses.groupBy("filename", "macro").agg(F.count("*").alias("n"))
    defined = macros.groupBy("filename", "macro").agg(
        F.collect_list(F.struct("spot", F.struct("value").alias("known"))).alias("all")
    )
    weighed = defined.hint("merge").join(counts, ["filename", "macro"])
    found = lookup(uses, weighed, ["filename", "macro"], "n", "id", how="inner", large=True)
    force = F.array_max(F.filter("all", lambda d: d["spot"] < F.col("spot")))["known"].alias("known")
    known = (
        found.select("id", "macro", force).where(F.col("known").isNotNull())
        .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("macro", "known"))).alias("_known"))
    )
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def filled(p: Column) -> Column:
        name = F.lower(p["text"])
        own = F.col("_known")[name]
        value = F.when(own.isNotNull(), own["value"]).otherwise(F.coalesce(months[name], p["text"]))
        ready = p["macro"] & value.isNotNull()
        return p.withField("text", F.when(ready, value).otherwise(p["text"])).withField("macro", p["macro"] & ~ready)

    return entries.join(known.hint("merge"), "id", "left").select(
        "id", "filename", "spot", F.transform("parts", filled).alias("parts")
    )


def _definitions(strings: DataFrame) -> DataFrame:
    """``(filename, macro, spot, value)`` of macro entries, however long their chains are.

    A definition may use macros that are defined before it, so a round fills in
    the values that are known by then, and there can be no cycle: a name in its
    own definition is the one before, or stands for itself. There are as many
    rounds as the longest chain has links.
    """
    open_ = F.exists("parts", lambda p: p["macro"])
    # The name stays with the first part, whatever becomes of the parts.
    while True:
        named = strings.select(
            "filename",
            F.col("parts")[0]["name"].alias("macro"),
            "spot",
            F.when(~open_, _text_of(F.col("parts"))).alias("value"),
        )
        if strings.where(open_).isEmpty():
            return named
        strings = cut_lineage(_with_macros(strings, named))


def parse_bibtex(texts: DataFrame) -> DataFrame:
    """Records of BibTeX text ``(filename, value)``, one row per file or chunk.

    Chunks of one file are in order by the column ``split`` where there is one,
    and by their rows inside it. Entries are cut out and spread by Spark; only
    the scan of one entry runs in Python. The definition of a macro in force at
    an entry is the last one before it in its file; definitions may be built
    from others. Parts joined by ``#`` are one value.
    """
    split = F.col("split").cast("long") if "split" in texts.columns else F.lit(0).cast("long")
    chunks = texts.select(
        "filename",
        split.alias("split"),
        F.monotonically_increasing_id().alias("row"),
        F.posexplode(F.split("value", r"(?m)^\s*(?=@)")).alias("at", "entry"),
    ).where(F.col("entry").rlike(r"(?is)^\s*@\s*(?!comment|preamble)\w+\s*[{(]"))
    entries = chunks.select("filename", F.struct("split", "row", "at").alias("spot"), "entry")
    scanned = entries.mapInPandas(_entry_parts, f"filename string, spot {_SPOT}, kind string, parts {_PARTS}")
    # Written once, since the ids have to stay the same for all readers.
    placed = cut_lineage(scanned.withColumn("id", F.monotonically_increasing_id()))
    strings = placed.where((F.col("kind") == "string") & (F.size("parts") > 0))
    records = placed.where(F.col("kind") != "string").select("id", "filename", "spot", "parts")
    # Most files use no macro; then nothing moves.
    if not records.where(F.exists("parts", lambda p: p["macro"])).isEmpty():
        records = _with_macros(records, _definitions(strings.select("id", "filename", "spot", "parts")))

    def field(name: str) -> Column:
        own = F.filter("parts", lambda p: p["name"] == name)
        text = F.trim(F.regexp_replace(_text_of(own), r"\s+", " "))
        return F.when(F.size(own) > 0, text)

    doi = field("doi")
    return records.select(
        field("title").alias("title"),
        F.coalesce(field("abstract"), F.lit("")).alias("abstract"),
        F.replace(F.coalesce(field("author"), F.lit("")), F.lit(" and"), F.lit(";")).alias("authors"),
        F.replace(F.coalesce(field("keywords"), F.lit("")), F.lit(", "), F.lit("; ")).alias("keywords"),
        F.coalesce(field("booktitle"), field("journal"), F.lit("")).alias("source"),
        field("year").cast("int").alias("year"),
        F.coalesce(doi, F.lit(MISSING)).alias("doi"),
        F.coalesce(field("url"), doi_url(doi), F.lit(MISSING)).alias("url"),
        "filename",
    )


def read_bibtex(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Records of ``.bib`` files, cut at entries while they are read.

    The reader splits the text at ``\\n@``, so a file larger than one split is
    read by several tasks.
    """
    raw = spark.read.option("lineSep", "\n@").text(path if isinstance(path, str) else list(path))
    entries = raw.select(
        file_stem(F.col("_metadata.file_path")).alias("filename"),
        F.col("_metadata.file_block_start").alias("split"),
        F.when(F.startswith(F.ltrim("value"), F.lit("@")), F.col("value"))
        .otherwise(F.concat(F.lit("@"), F.col("value")))
        .alias("value"),
    )
    return parse_bibtex(entries)


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV and BibTeX exports of a folder; headers follow the file stem."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    paths = sorted(str(f.getPath()) for f in files)
    groups: dict[int, tuple[Mapping[str, str] | None, list[str]]] = {}
    for path in (p for p in paths if p.endswith(".csv")):
        stem = path.rsplit("/", 1)[-1].removesuffix(".csv")
        kind = HEADERS_BY_STEM.get(stem)
        # Files without a known stem may differ in columns, so each is read alone.
        key = id(kind) if kind else hash(path)
        groups.setdefault(key, (kind, []))[1].append(path)
    parts = [read_csv(spark, files, kind) for kind, files in groups.values()]
    bib = [p for p in paths if p.endswith(".bib")]
    if bib:
        parts.append(read_bibtex(spark, bib))
    if not parts:
        raise ValueError(f"no .csv or .bib files in {folder}")
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


READERS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def read_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A rating or result table by its suffix; the key column must be there."""
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    if suffix == ".bib":
        df = read_bibtex(spark, path)
    elif suffix in READERS:
        options = {}
        if READERS[suffix] == "csv":
            options = {
                "header": True,
                "sep": "\t" if suffix == ".tsv" else ",",
                "multiLine": True,
                "escape": '"',
            }
        df = spark.read.format(READERS[suffix]).options(**options).load(path)
    else:
        raise ValueError(f"unsupported file type: {suffix}")
    if key not in df.columns:
        raise ValueError(f"column {key!r} was not found in {path}")
    return df


def read_raters(spark: SparkSession, paths: Sequence[str], key: str) -> DataFrame:
    """Rater files as one table, each row tagged with the stem of its file."""
    table = None
    for path in paths:
        rater = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        part = read_table(spark, path, key).withColumn("rater", F.lit(rater))
        table = part if table is None else table.unionByName(part, allowMissingColumns=True)
    return table


def union_tagged(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union all of tables by name, each tagged with its key."""
    result = None
    for name, df in tables.items():
        part = df.withColumn(tag, F.lit(name))
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result
