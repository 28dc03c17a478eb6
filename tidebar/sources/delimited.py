"""Delimited text files whose delimiter, header names, encoding and number style differ per file.

Files are read as splittable text. Every line that carries the required header names is a header; its file,
delimiter and column positions become one row of a header table that is joined back to the data lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (";", ",", "\t", "|")
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucn"


def fold_text(column: Column) -> Column:
    """Lower case without accents, keeping letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(column), ACCENTED, PLAIN), "[^a-z0-9]", "")


# What the Windows code page 1252 has at 0x80-0x9F, where ISO-8859-1 has control characters.
CP1252_AT = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CONTROLS_AT = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def read_lines(spark: SparkSession, paths: Sequence[str], keep: Callable[[Column], Column] | None = None, **options: str) -> DataFrame:
    """(file, name, line, line_key): lines in UTF-8 (byte order mark removed), otherwise in code page 1252.

    ``line_key`` grows along the lines of a file: the block of the file in units of 64 KiB, then the position inside
    the scan, whose rows keep their order. ``keep`` is a condition on the file name, applied before lines are read;
    ``options`` go to the reader.
    """
    raw = spark.read.options(**options).text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("_start"), F.col("value")
    )
    if keep is not None:
        raw = raw.where(keep(F.col("name")))
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = raw.withColumn("line_key", F.shiftleft(F.shiftright("_start", 16), 33).bitwiseOR(position))
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    decoded = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.translate(latin, CONTROLS_AT, CP1252_AT))
    line = F.regexp_replace(F.regexp_replace(decoded, "^﻿", ""), "\r$", "")
    return raw.select("file", "name", line.alias("line"), "line_key").where(F.trim("line") != "")


@dataclass(frozen=True)
class Layout:
    """Canonical columns with their accepted header names (folded), in order of preference."""

    aliases: Mapping[str, Sequence[str]]
    required: Sequence[str]                      # columns a header must have
    any_of: Sequence[Sequence[str]] = ()         # further groups of which one member must be present


def split_fields(line: Column, delimiter: Column) -> Column:
    """Fields of a line as an array of strings; delimiters inside double quotes do not split."""
    literal = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    outside_quotes = F.concat(literal, F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    unquote = lambda c: F.replace(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return F.when(F.contains(line, F.lit('"')), F.transform(F.split(line, outside_quotes), unquote)).otherwise(
        F.split(line, literal)
    )


def sniff_delimiter(line: Column) -> Column:
    """The delimiter that occurs most often; earlier in the list on ties."""
    counts = F.array(*[
        F.struct((F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d"))
        for i, d in enumerate(DELIMITERS)
    ])
    return F.array_max(counts)["d"]


def read_columns(spark: SparkSession, lines: DataFrame, layout: Layout) -> DataFrame:
    """Data lines as string columns named by the layout, plus ``file``, ``name`` and ``line_key``.

    A header line never yields a row. ``line_key`` orders the lines of a file as they stand in it.
    """
    names = list(layout.aliases)
    wordy = F.col("line").rlike("[A-Za-z]{3}")
    tagged = lines.withColumn("_delim", F.when(wordy, sniff_delimiter(F.col("line"))))
    quote_free = F.replace(F.col("line"), F.lit('"'), F.lit(""))
    tokens = F.transform(F.split(quote_free, F.concat(F.lit("\\Q"), F.col("_delim"), F.lit("\\E"))), fold_text)
    position = lambda aliases: F.coalesce(*[F.nullif(F.array_position("_tokens", F.lit(a)), F.lit(0)) for a in aliases]) - 1
    heads = tagged.where(F.col("_delim").isNotNull()).withColumn("_tokens", tokens)
    heads = heads.select("file", "line", "_delim", *[position(layout.aliases[n]).alias(f"_p_{n}") for n in names])
    fit = F.lit(True)
    for n in layout.required:
        fit = fit & F.col(f"_p_{n}").isNotNull()
    for group in layout.any_of:
        some = F.lit(False)
        for n in group:
            some = some | F.col(f"_p_{n}").isNotNull()
        fit = fit & some
    pack = F.struct(F.col("line").alias("head"), "_delim", *[f"_p_{n}" for n in names])
    headers = heads.where(fit).groupBy("file").agg(F.min(pack).alias("_h")).select("file", "_h.*")
    joined = lines.join(headers, "file").where(F.col("line") != F.col("head"))
    fields = joined.withColumn("_f", split_fields(F.col("line"), F.col("_delim")))
    return fields.select(
        "file", "name", "line_key",
        *[F.trim(F.get("_f", F.col(f"_p_{n}").cast("int"))).alias(n) for n in names],
        *[F.col(f"_p_{n}").isNotNull().alias(f"has_{n}") for n in names],
    )


def blank_to_null(column: Column) -> Column:
    text = F.trim(column)
    return F.when(~text.isin("", "nan", "None", "-"), text)


def strip_money(column: Column) -> Column:
    """Remove currency and unit marks."""
    return F.regexp_replace(F.regexp_replace(F.replace(column, F.lit("R$"), F.lit("")), "(?i)pts", ""), "[% ]", "")


def number_style(column: Column, thousands: bool = True) -> Column:
    """Aggregate: style of a numeric text column of one file.

    'both' (dot groups, comma decimal), 'comma' (comma decimal), 'group' (dots only, mostly groups of
    three), 'plain'. All values of the file vote.
    """
    text = blank_to_null(column)
    comma, dot = F.bool_or(F.contains(text, F.lit(","))), F.bool_or(F.contains(text, F.lit(".")))
    grouped = F.avg(F.when(text.isNotNull(), text.rlike(r"^-?\d{1,3}(\.\d{3})+$").cast("double")))
    style = F.when(comma & dot, "both").when(comma, "comma")
    if thousands:
        style = style.when(dot & (grouped > 0.6), "group")
    return style.otherwise("plain")


def parse_number(column: Column, style: Column) -> Column:
    text = blank_to_null(column)
    dotless = F.replace(text, F.lit("."), F.lit(""))
    return (
        F.when(style == "both", F.replace(dotless, F.lit(","), F.lit(".")))
        .when(style == "comma", F.replace(text, F.lit(","), F.lit(".")))
        .when(style == "group", dotless)
        .otherwise(text)
        .try_cast("double")
    )


def _prepared(column: Column) -> Column:
    return F.replace(F.regexp_replace(F.trim(column), "(?<=\\d)T(?=\\d)", " "), F.lit("/"), F.lit("-"))


def iso_stamp(column: Column) -> Column:
    text = _prepared(column)
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp_ntz"))


def _two_part(column: Column, day: int, month: int) -> Column:
    """Dates written as two numbers and a year; ``day`` and ``month`` give their places."""
    text = _prepared(column)
    long_year = F.regexp_replace(text, r"^(\d{1,2})-(\d{1,2})-(\d{4})(.*)$", f"$3-${month}-${day}$4")
    short_year = F.regexp_replace(text, r"^(\d{1,2})-(\d{1,2})-(\d{2})( .*)?$", f"20$3-${month}-${day}$4")
    return (
        F.when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}"), long_year.try_cast("timestamp_ntz"))
        .when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{2}( |$)"), short_year.try_cast("timestamp_ntz"))
    )


def day_first(column: Column) -> Column:
    """ISO or day-first date; null where neither reading is possible."""
    return F.coalesce(iso_stamp(column), _two_part(column, 1, 2))


def month_first(column: Column) -> Column:
    """ISO or month-first date; null where neither reading is possible."""
    return F.coalesce(iso_stamp(column), _two_part(column, 2, 1))


def file_stamp(column: Column, some_day_first: Column) -> Column:
    """Date of a file that is day-first, unless none of its dates can be read so; then all of them are month-first."""
    return F.when(some_day_first, day_first(column)).otherwise(month_first(column))


def book_stamp(column: Column) -> Column:
    """Date of a trade book, row by row: ISO, day-first where slashes part it; all else month-first, then day-first."""
    slashed = F.when(F.trim(column).rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}"), _two_part(column, 1, 2))
    return F.coalesce(iso_stamp(column), slashed, _two_part(column, 2, 1), _two_part(column, 1, 2))


def with_file_styles(rows: DataFrame, columns: Sequence[str], thousands: bool = True, stamp: Column | None = None) -> DataFrame:
    """Attach ``style_<column>`` and, for a date column, ``day_first``, decided once per file by a map-side combined aggregation."""
    styles = [number_style(F.col(c), thousands).alias(f"style_{c}") for c in columns]
    if stamp is not None:
        styles.append(F.bool_or(day_first(stamp).isNotNull()).alias("day_first"))
    return rows.join(rows.groupBy("file").agg(*styles), "file")
