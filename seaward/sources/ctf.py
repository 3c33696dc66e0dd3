"""Station files in the CODAR tabular format: parsing to tables, and rendering tables as such text.

Files are read with Spark's binary source and parsed where they are; a file is one row until it is exploded to table
rows, so parsing needs no shuffle.  The parser takes a file's bytes in slices and gives table rows back as text in blocks of
lines, which Spark splits as it explodes them: nothing in Python or in a row is larger than the file's own text.  Values are
bound by column name, never by position.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seaward.functions.headers import header, receiver, site_code, time_of

FILL_VALUES = (999.0, 1080.0)
RADIAL_COLUMNS = {
    c: "int" if c in ("VFLG", "ERSC", "ERTC", "SPRC") else "double"
    for c in "LOND LATD VELU VELV VFLG ESPC ETMP MAXV MINV ERSC ERTC XDST YDST RNGE BEAR VELO HEAD SPRC EVAR EACC".split()
}
WAVE_COLUMNS = dict.fromkeys("MWHT MWPD WAVB WNDB PMWH ACNT DIST RCLL WDPT MTHD FLAG WHNM WHSD".split(), "double")
TIME_PARTS = "TYRS TMON TDAY THRS TMIN TSEC".split()
#: Decimals of each column in exported text; others have three.
DECIMALS = {"LOND": 7, "LATD": 7, "ESPC": 3, "ETMP": 3, "BEAR": 1, "HEAD": 1, "RNGE": 4, "XDST": 4, "YDST": 4}
#: Fixed values of the file format: lines before the list of tests in a quality-controlled file.
QC_LINES = (
    "%QCFileVersion: 2.0.0",
    "%QCReference: Quality control reference: IOOS QARTOD HF Radar ver 2.0 June 2022",
    "%QCFlagDefinitions: 1=pass 2=not_evaluated 3=suspect 4=fail 9=missing_data",
    '%QCTestFormat: "test_name [qc_thresholds]: test_result"',
)
_SCHEMA = """path string, is_corrupt boolean, is_wera boolean, kind string, meta map<string,string>, head array<string>,
 foot array<string>, processing_tools array<string>,
 tables array<struct<table_no:int,table_type:string,columns:array<string>,meta:map<string,string>,head:array<string>,n_rows:int,n_cols:int,blocks:array<string>>>"""
#: Bytes of a file that are taken at once, lines of a block.
SLICE_BYTES, BLOCK_LINES = 1 << 20, 1000


def lines_of(data, encoding: str):
    """The lines of a text given as bytes (any buffer), decoded slice by slice; slices end behind a line feed."""
    view, at, size = memoryview(data), 0, SLICE_BYTES
    while at < len(view):
        part = bytes(view[at : at + size])
        if at + size < len(view):
            end = part.rfind(b"\n") + 1
            if not end:  # a longer line
                size *= 2
                continue
            part = part[:end]
        at, size = at + len(part), SLICE_BYTES
        yield from part.decode(encoding).splitlines()


def parse_lines(lines) -> dict:
    """One file from its lines.

    ``head`` and ``foot`` are the header and footer lines in their order, also of each table; ``kind`` says of wave files
    whether their first table has distances (ranged) or not (averaged).  ``blocks`` are a table's rows: a line for each, its
    values joined by one space, ``BLOCK_LINES`` lines in a block; ``n_cols`` counts the values of the first.
    """
    head: list[str] = []
    foot: list[str] = []
    meta: dict[str, str] = {}
    tools: list[str] = []
    tables: list[dict] = []
    open_table: dict | None = None
    block: list[str] = []
    ended = False
    for line in lines:
        mark = line.strip()
        if not mark or mark.startswith("%%"):
            continue
        if re.match(r"%End\b", mark):
            ended = True
            foot.append(mark)
        elif mark.startswith("%") and ":" in mark:
            name, value = (mark.split(":") + [""])[:2]
            name, value = name.replace("%", "").strip(), value.replace("%", "").strip()
            if name == "TableType":
                open_table, block = {"table_type": value, "columns": [], "meta": {}, "head": [], "n_rows": 0, "n_cols": 0, "blocks": [], "reading": False}, []
            if name == "TableStart" and open_table is not None:
                open_table["reading"] = True
            elif name == "TableEnd" and open_table is not None:
                if block:
                    open_table["blocks"].append("\n".join(block))
                tables.append(open_table)
                open_table = None
            elif open_table is not None:
                open_table["meta"][name] = value
                if name != "TableType":
                    open_table["head"].append(mark)
                if name == "TableColumnTypes":
                    open_table["columns"] = value.split()
            elif name == "ProcessingTool" and tables:
                tools.append(value)
                foot.append(mark)
            else:
                meta[name] = value
                (foot if tables else head).append(mark)
        elif open_table is not None and open_table["reading"] and open_table["columns"]:
            values = mark.lstrip("%").split()
            if not open_table["n_rows"]:
                open_table["n_cols"] = len(values)
            open_table["n_rows"] += 1
            block.append(" ".join(values))
            if len(block) == BLOCK_LINES:
                open_table["blocks"].append("\n".join(block))
                block = []
    for n, t in enumerate(tables, 1):
        t["table_no"] = n
        t.pop("reading")
    kind = None
    if tables and tables[0]["table_type"].startswith("WAVL"):
        at = tables[0]["columns"].index("DIST") if "DIST" in tables[0]["columns"] else None
        rows = (r.split(" ") for b in tables[0]["blocks"] for r in b.split("\n"))
        kind = "ranged" if at is not None and any(_is_number(r[at]) for r in rows if len(r) > at) else "averaged"
    return {"is_corrupt": not ended, "is_wera": "WERA" in meta.get("Manufacturer", ""), "kind": kind, "meta": meta, "head": head, "foot": foot, "processing_tools": tools, "tables": tables}


def _is_number(text: str) -> bool:
    try:
        return float(text) == float(text)
    except ValueError:
        return False


def parse_files(contents: DataFrame) -> DataFrame:
    """One row per file from ``path`` and ``content`` (bytes, or text), file by file."""
    schema = T._parse_datatype_string(_SCHEMA)
    arrow = to_arrow_schema(schema)

    encoding = "utf-8" if dict(contents.dtypes)["content"] == "string" else "ISO-8859-1"

    def one(path: str, data):
        import pyarrow as pa

        found = parse_lines(lines_of(data, encoding))
        for holder in (found, *found["tables"]):
            holder["meta"] = list(holder["meta"].items())
        return pa.RecordBatch.from_pylist([{"path": path, **found}], schema=arrow)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                yield one(path.as_py(), content.as_buffer())

    return contents.select("path", "content").mapInArrow(run, schema)


def contents(spark: SparkSession, path: str | list[str], pattern: str | list[str] = "*", recursive: bool = True) -> DataFrame:
    """path, content, and file_name, prefix, named_site and file_time from the name, of the files that match a pattern.

    The parts of the name come from the file's metadata, not from its content: Spark evaluates filters on them while it lists
    the files, and files that do not pass are never opened.
    """
    globs = pattern if isinstance(pattern, str) else "{" + ",".join(pattern) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", globs).option("recursiveFileLookup", recursive).load(path)
    return found.select("path", "content", *(c.alias(n) for n, c in name_parts(F.col("_metadata.file_name")).items()), site_in_name(F.col("_metadata.file_name")).alias("named_site"))


def chosen_files(found: DataFrame, prefix: str | list[str] | None = None, sites: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Of ``contents`` (or a catalogue) the files of some prefixes and sites, from ``start`` to ``end`` (both inclusive)."""
    if prefix is not None:
        found = found.filter(F.col("prefix").isin([prefix] if isinstance(prefix, str) else list(prefix)))
    if sites is not None:
        found = found.filter(F.col("named_site").isin(list(sites)))
    if start is not None:
        found = found.filter(F.col("file_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        found = found.filter(F.col("file_time") <= F.lit(end).cast("timestamp"))
    return found


def read_files(spark: SparkSession, path: str | list[str], pattern: str | list[str] = "*", recursive: bool = True, prefix=None, sites=None, start=None, end=None) -> DataFrame:
    """Parsed files under ``path`` whose names match a pattern; of those only the ``chosen_files`` are opened."""
    found = chosen_files(contents(spark, path, pattern, recursive), prefix, sites, start, end)
    return parse_files(found.select("path", "content"))


def name_parts(path: Column) -> dict[str, Column]:
    """Name, prefix and the time in the name of each path."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    stamp = F.regexp_extract(name, r"(\d{4}_\d{2}_\d{2}_\d{4})", 1)
    return {
        "file_name": name,
        "prefix": F.regexp_extract(name, "^([A-Za-z0-9]+)_", 1),
        "file_time": F.try_to_timestamp(stamp, F.lit("yyyy_MM_dd_HHmm")),
    }


def site_in_name(path: Column) -> Column:
    """The site that stands after the prefix in the name of a path."""
    return F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), "^[A-Za-z0-9]+_([A-Za-z0-9]+)_", 1)


def file_table(parsed: DataFrame) -> DataFrame:
    """The catalogue row of each file: names, times, header, columns and sizes."""
    first = F.get(F.filter("tables", lambda t: t["table_no"] == 1), F.lit(0))
    return parsed.withColumns(name_parts(F.col("path"))).select(
        "path", "file_name", "prefix", site_code(header(F.col("meta"), "Site")).alias("site"), "file_time",
        time_of(header(F.col("meta"), "TimeStamp")).alias("time"), header(F.col("meta"), "FileType").alias("file_type"),
        F.map_concat("meta", F.coalesce(first["meta"], F.create_map().cast("map<string,string>"))).alias("meta"),
        "processing_tools", F.coalesce(first["columns"], F.array().cast("array<string>")).alias("columns"),
        F.coalesce(first["n_rows"], F.lit(0)).alias("n_rows"), F.coalesce(first["n_cols"], F.lit(0)).alias("n_cols_row"), "is_wera", "is_corrupt",
    )


def table_rows(parsed: DataFrame, type_like: str, columns: dict[str, str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows of all tables whose type holds ``type_like``; columns that a file lacks are null."""
    named = parsed.filter(~F.col("is_corrupt")).withColumns(name_parts(F.col("path")))
    kept = [c for c in extra if c in ("kind", "lon", "lat")]
    if "lon" in kept:
        named = named.withColumns(dict(zip(("lon", "lat"), receiver(F.col("meta")), strict=True)))
    tables = named.select("path", "prefix", *kept, site_code(header(F.col("meta"), "Site")).alias("site"), time_of(header(F.col("meta"), "TimeStamp")).alias("time"), F.explode("tables").alias("t"))
    told = ("path", "prefix", "site", "time", *kept)
    blocks = tables.filter(F.contains("t.table_type", F.lit(type_like))).select(*told, F.col("t.table_no").alias("table_no"), F.col("t.columns").alias("cols"), F.posexplode("t.blocks").alias("block_no", "block"))
    lines = blocks.select(*told, "table_no", "cols", "block_no", F.posexplode(F.split("block", "\n")).alias("line_no", "line"))
    number_in_table = (F.col("block_no") * F.lit(BLOCK_LINES) + F.col("line_no")).alias("row_no")
    rows = lines.select(*told, "table_no", "cols", number_in_table, F.when(F.col("line") != "", F.split("line", " ")).alias("v"))
    value = lambda c: F.get("v", F.array_position("cols", c) - 1)
    number = lambda c, kind: F.when(~F.isnan(value(c).try_cast("double")), value(c).try_cast("double")).cast(kind)
    has = lambda c: F.array_contains("cols", c)
    name = lambda c: "TIME_S" if c == "TIME" else c  # noqa: E731  the table's own seconds; "time" is the row's timestamp
    picked = [F.when(has(c), number(c, k) if k != "string" else value(c)).alias(name(c)) for c, k in columns.items()]
    parts = [F.when(has(c), number(c, "int")).alias(c) for c in TIME_PARTS] if "TYRS" in extra else []
    return rows.select("path", "prefix", "site", "time", *kept, "table_no", "row_no", *picked, *parts)


def fill_to_null(df: DataFrame, columns=None, values=FILL_VALUES) -> DataFrame:
    """Fill values to null, by exact equality, in the given (or all numeric) columns."""
    chosen = columns or [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint")]
    return df.withColumns({c: F.when(~F.col(c).isin(*values), F.col(c)) for c in chosen})


def read_radials(parsed: DataFrame, flip: bool = False) -> DataFrame:
    """Vectors of radial files, fill values as nulls."""
    rows = fill_to_null(table_rows(parsed, "LLUV", RADIAL_COLUMNS), list(RADIAL_COLUMNS))
    return flip_velocity(rows) if flip else rows


def flip_velocity(df: DataFrame) -> DataFrame:
    """The other sign for velocities (the extremes keep their names)."""
    return df.withColumns({c: -F.col(c) for c in ("MINV", "MAXV", "VELO") if c in df.columns})


def read_waves(parsed: DataFrame, columns: dict[str, str] | None = None, positions: bool = False) -> DataFrame:
    """Wave rows: all tables of files with ranges, the first table of averaged files; ``kind`` says which.

    ``columns`` are read besides the wave columns; with ``positions`` the receiver's lon and lat come along from the header of
    the same file.
    """
    wanted = WAVE_COLUMNS | (columns or {})
    rows = fill_to_null(table_rows(parsed, "WAVL", wanted, ("TYRS", "kind", *(("lon", "lat") if positions else ()))), list(WAVE_COLUMNS))
    chosen = rows.filter((F.col("kind") == "ranged") | (F.col("table_no") == 1))
    return chosen.withColumn("time", F.make_timestamp(*(F.col(c) for c in TIME_PARTS))).drop(*TIME_PARTS)


def read_diagnostics(parsed: DataFrame, type_like: str, columns: dict[str, str]) -> DataFrame:
    """Diagnostics rows of one table type, with their own times; fill values stay."""
    rows = table_rows(parsed, type_like, columns, ("TYRS",))
    return rows.withColumn("time", F.make_timestamp(*(F.col(c) for c in TIME_PARTS))).drop(*TIME_PARTS)


def render_files(rows: DataFrame, header_lines: Column, columns: dict[str, str], table_type: str, qc_lines: Column | None = None) -> DataFrame:
    """One text per path: header, one table of the given columns (name -> printf format), footer.

    Nulls are written as 999.  ``header_lines`` and ``qc_lines`` are arrays of text, equal for all rows of a path.
    """
    cells = [F.format_string(f, F.coalesce(F.col(c), F.lit(999.0 if "f" in f else 999))) for c, f in columns.items()]
    lines = rows.select("path", header_lines.alias("h"), (qc_lines if qc_lines is not None else F.array().cast("array<string>")).alias("q"), "row_no", F.concat_ws("  ", *cells).alias("line"))
    files = lines.groupBy("path").agg(F.first("h").alias("h"), F.first("q").alias("q"), F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("l"))
    start = F.array(
        F.lit(f"%TableType: {table_type}"), F.lit(f"%TableColumns: {len(columns)}"), F.lit(f"%TableColumnTypes: {' '.join(columns)}"),
        F.concat(F.lit("%TableRows: "), F.size("l").cast("string")), F.lit("%TableStart:"),
    )
    end = F.array(F.lit("%TableEnd:"), F.lit("%%"), F.lit("%End:"))
    body = F.concat("h", "q", start, F.transform("l", lambda x: x["line"]), end)
    return files.select("path", F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("value"))


def export_files(rows: DataFrame, parsed: DataFrame, columns: dict[str, str], added: tuple[str, ...] = (), qc_lines: str | None = None) -> DataFrame:
    """path, value: the text of each parsed file with the rows of its path as its first table.

    Header, other tables and footer are the file's own, in their order.  The first table has the file's columns that
    ``columns`` (name -> type) knows, then those ``added`` (flags); its counts are rewritten, nulls are written as 999.
    ``qc_lines`` is a column of ``parsed`` (array of text) with the tests that ran.  Rows meet their file in one shuffle by
    path, and one file's lines are one value.
    """
    known = {c: k for c, k in columns.items() if (c if c != "TIME" else "TIME_S") in rows.columns}
    number = lambda c: F.col("TIME_S" if c == "TIME" else c)

    def text(c: str, kind: str):
        if kind == "string":
            return F.coalesce(number(c), F.lit("999"))
        if kind == "int":
            return F.format_string("%d", F.coalesce(number(c).cast("long"), F.lit(999)))
        return F.format_string(f"%.{DECIMALS.get(c, 3)}f", F.coalesce(number(c), F.lit(999.0)))

    files = parsed.filter(~F.col("is_corrupt")).withColumn("first", F.get(F.filter("tables", lambda t: t["table_no"] == 1), F.lit(0)))
    names = F.array(*(F.lit(c) for c in known))
    files = files.withColumn("written", F.concat(F.filter(F.col("first")["columns"], lambda c: F.array_contains(names, c)), F.array(*(F.lit(c) for c in added)).cast("array<string>")))
    values = F.create_map(*(x for c, k in (known | dict.fromkeys(added, "int")).items() for x in (F.lit(c), text(c, k))))
    lines = rows.join(files.select("path", "written"), "path").select("path", "row_no", F.array_join(F.transform("written", lambda c: F.element_at(values, c)), "  ").alias("line"))
    grouped = lines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("lines"))
    out = files.join(grouped, "path", "left").withColumn("lines", F.coalesce(F.transform("lines", lambda x: F.concat(F.lit(" "), x["line"])), F.array().cast("array<string>")))
    counted = F.transform(
        F.col("first")["head"],
        lambda h: F.when(F.startswith(h, F.lit("%TableColumns:")), F.concat(F.lit("%TableColumns: "), F.size("written").cast("string")))
        .when(F.startswith(h, F.lit("%TableColumnTypes:")), F.concat(F.lit("%TableColumnTypes: "), F.array_join("written", " ")))
        .when(F.startswith(h, F.lit("%TableRows:")), F.concat(F.lit("%TableRows: "), F.size("lines").cast("string")))
        .otherwise(h),
    )
    ran = F.concat(F.array(*(F.lit(x) for x in QC_LINES)), F.col(qc_lines)) if qc_lines else F.array().cast("array<string>")
    kind = lambda t: F.array(F.concat(F.lit("%TableType: "), t["table_type"]))
    first = F.concat(ran, kind(F.col("first")), counted, F.array(F.lit("%TableStart:")), F.col("lines"), F.array(F.lit("%TableEnd:"), F.lit("%%")))
    others = F.flatten(
        F.transform(
            F.filter("tables", lambda t: t["table_no"] > 1),
            lambda t: F.concat(
                kind(t),
                t["head"],
                F.array(F.concat(F.lit("%TableStart: "), t["table_no"].cast("string"))),
                F.flatten(F.transform(t["blocks"], lambda b: F.transform(F.split(b, "\n"), lambda r: F.concat(F.lit("%  "), F.replace(r, F.lit(" "), F.lit("  ")))))),
                F.array(F.concat(F.lit("%TableEnd: "), t["table_no"].cast("string")), F.lit("%%")),
            ),
        )
    )
    body = F.when(F.col("first").isNull(), F.concat("head", "foot")).otherwise(F.concat("head", first, others, "foot"))
    return out.select("path", F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("value"))
