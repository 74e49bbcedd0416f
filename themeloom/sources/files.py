"""Reading answer tables from delimited files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions.ordering import dense_index
from themeloom.functions.storage import broadcast_if_small, stage

# Cell texts read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
EXTENSIONS = (".csv", ".tsv")
FALLBACK_ENCODING = "ISO-8859-1"


def check_columns(df: DataFrame, required: Sequence[str], text: str | None = None) -> tuple[bool, str]:
    """Whether the required columns are there and the text column holds strings; no job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        return False, f"no column {', '.join(missing)} among {', '.join(df.columns)}"
    if text and not isinstance(df.schema[text].dataType, T.StringType):
        return False, f"column {text} holds {df.schema[text].dataType.simpleString()}, not strings"
    return True, "ok"


def validate_input(spark: SparkSession, path: str, required: Sequence[str]) -> tuple[bool, str]:
    """Whether ``path`` exists, has a supported extension and the required columns. Reads the header."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and not name.lower().endswith(EXTENSIONS):
        return False, f"files ending in .{name.rsplit('.', 1)[1]} are not read, only {', '.join(EXTENSIONS)}"
    try:
        header = spark.read.csv(path, header=True, sep=_separator(path))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False, f"there is no {path}"
        return False, f"{path} cannot be read: {e}"
    return check_columns(header, required)


def _separator(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def valid_bytes(cell: Column | str) -> Column:
    """Whether a cell read as Latin-1, which keeps every byte, is UTF-8; a null is."""
    return F.coalesce(F.is_valid_utf8(_as_utf8(cell)), F.lit(True))


def _as_utf8(cell: Column | str) -> Column:
    return F.encode(cell, FALLBACK_ENCODING).cast("string")


def total_bytes(spark: SparkSession, path: str | Sequence[str]) -> int:
    """The size of the files in ``path``; their contents are not read."""
    listed = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return listed.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]


def missing_to_null(cell: Column | str, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """A cell, or null if it is a missing-value token."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.when(~cell.isin(*tokens), cell)


def decoded(content: Column | str) -> Column:
    """Bytes as text: UTF-8 if they are valid UTF-8, else Latin-1."""
    content = F.col(content) if isinstance(content, str) else content
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, FALLBACK_ENCODING))


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str | None = None,
    schema: T.StructType | str | None = None,
    text: str | None = None,
    na_tokens: Sequence[str] | None = NA_TOKENS,
    row_id: str | None = "row_id",
    encoding: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Read CSV or TSV files with a header row.

    Files are read in the given ``encoding``; without one, as UTF-8, and those that are not valid UTF-8
    as Latin-1. Missing-value tokens become null in the text
    column, or in all string columns if none is named. ``row_id`` numbers the rows in file order;
    pass None if the data has its own key.

    The files are parsed once, in an encoding that keeps every byte, and staged; whether a file is UTF-8
    is the conjunction over the cells of its string columns, and its cells are decoded when they meet that verdict.
    Without a ``schema``, names come from the first header and types from the staged cells. A schema's names
    are checked against the headers if all are ASCII. If no quoted cell spans lines set ``multi_line=False``,
    which lets many tasks share one file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.options(header=True, sep=sep or _separator(paths[0]), multiLine=multi_line, escape='"', encoding=encoding or FALLBACK_ENCODING)
    infer = schema is None
    if infer:
        # Only the first line of one file is read for this.
        fields = reader.csv(paths).schema.fields
    else:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    ascii_names = all(f.name.isascii() for f in fields)
    parsed = reader.schema(T.StructType(fields)).options(enforceSchema=not ascii_names).csv(paths)
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    valid = reduce(Column.__and__, [valid_bytes(F.col(f"`{c}`")) for c in strings], F.lit(True))
    whole = parsed.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        (F.lit(True) if encoding else valid).alias("_valid"),
    )
    numbered = file_order(whole, row_id or "_row")
    tokens = list(na_tokens or ())

    def cell(name: str) -> Column:
        raw = F.col(f"`{name}`")
        return raw if encoding else F.when(F.col("_utf8"), _as_utf8(raw)).otherwise(raw)

    names = {f.name: _decoded_name(f.name) if infer and not encoding else f.name for f in fields}
    targets = [c for c in strings if text in (None, names[c])] if tokens else []
    cells = {f.name: cell(f.name) if f.name in strings else F.col(f"`{f.name}`") for f in fields}
    if infer:
        types = cell_types(numbered.select(*[v.alias(c) for c, v in cells.items()]), [c for c in cells if names[c] != text], tokens)
        cells |= {c: cells[c].try_cast(t) for c, t in types.items()}
        targets = [c for c in targets if c not in types]
    return numbered.select(
        *([row_id] if row_id else []), *[(missing_to_null(v, tokens) if c in targets else v).alias(names[c]) for c, v in cells.items()]
    )


def _decoded_name(name: str) -> str:
    """A column's name, read as Latin-1, as UTF-8 if it is that; without a byte order mark."""
    try:
        return name.encode(FALLBACK_ENCODING).decode("utf-8-sig")
    except UnicodeError:
        return name


# Types that cells are tried as, narrowest first.
CELL_TYPES = ("int", "bigint", "double", "boolean", "timestamp")


def cell_types(cells: DataFrame, columns: Sequence[str], na_tokens: Sequence[str] = NA_TOKENS) -> dict[str, str]:
    """For columns of strings, the first of :data:`CELL_TYPES` that all cells can be read as, in one pass.

    Missing-value tokens fit every type. Columns without any other cell, or that fit no type, are left out.
    """
    if not columns:
        return {}
    measures = []
    for i, c in enumerate(columns):
        value = missing_to_null(F.trim(f"`{c}`"), list(na_tokens) or [""])
        measures += [F.count(value).alias(f"n{i}"), *[F.count(value.try_cast(t)).alias(f"{t}{i}") for t in CELL_TYPES]]
    found = cells.agg(*measures).head()
    fits = {c: [t for t in CELL_TYPES if found[f"{t}{i}"] == found[f"n{i}"]] for i, c in enumerate(columns) if found[f"n{i}"]}
    return {c: types[0] for c, types in fits.items() if types}


def file_order(df: DataFrame, row_id: str) -> DataFrame:
    """Add unique, rising row numbers by file (``_file``), block (``_block``) and place in the block, and ``_utf8``: whether
    all rows of the file are ``_valid``.

    The parsed rows are staged with their places first: how a file is split may change from one read to
    the next, a staged table stays. Numbers have gaps: the rank of the block in the upper bits, the row's
    place in its task in the lower. Files and blocks, with their verdicts, are a table; only it is ordered, by a range sort.
    """
    kept = [c for c in df.columns if c not in ("_file", "_block", "_valid")]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    staged = stage(df.withColumn("_place", place))
    blocks = stage(staged.groupBy("_file", "_block").agg(F.bool_and("_valid").alias("_valid")))
    verdicts = blocks.groupBy("_file").agg(F.bool_and("_valid").alias("_utf8"))
    ranks = stage(dense_index(blocks.select("_file", "_block"), ["_file", "_block"], "_rank").join(verdicts, "_file"))
    ranked = staged.join(broadcast_if_small(ranks), ["_file", "_block"], "left")
    rank = F.coalesce("_rank", F.raise_error(F.lit("a row of an unknown block")).cast("bigint"))
    return ranked.select((F.shiftleft(rank, 33) + F.col("_place")).alias(row_id), "_utf8", *[F.col(f"`{c}`") for c in kept])


def read_answers(spark: SparkSession, path: str | Sequence[str], text: str, required: Sequence[str] = (), **options) -> DataFrame:
    """Read and check a table of answers; raises if the text or a required column is missing."""
    df = read_delimited(spark, path, text=text, **options)
    ok, message = check_columns(df, list(required) or [text], text if text in df.columns else None)
    if not ok:
        raise ValueError(f"the table cannot be analysed: {message}")
    return df
