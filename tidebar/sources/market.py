"""Readers for bar and tick files and for trade books (inventory S1-S10)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.scans import Run, running, time_block
from tidebar.operators.bars import clean_bars, timeframe_label
from tidebar.sources.delimited import (
    Layout, book_stamp, file_stamp, fold_text, parse_number, read_columns, read_lines, strip_money, with_file_styles,
)

# Accepted header names per column.
BAR_LAYOUT = Layout(
    {
        "stamp": ("datahora", "datetime", "timestamp"), "date": ("data", "date"), "time": ("hora", "time"),
        "open": ("abertura", "open"), "high": ("maxima", "maximo", "high", "max"), "low": ("minima", "minimo", "low", "min"),
        "close": ("fechamento", "close", "ultimo", "preco"), "volume": ("volume", "quantidade", "qtd"),
    },
    required=("open", "high", "low", "close"),
    any_of=(("stamp", "date"),),
)
TICK_LAYOUT = Layout(
    {
        "date": ("data", "date"), "time": ("hora", "time"), "price": ("preco", "price", "ultimo", "close"),
        "volume": ("quantidade", "qtd", "volume"),
    },
    required=("date", "time", "price"),
)
OWN_BOOK = Layout(
    {
        "entry": ("entrytime", "abertura", "entrada", "opentime"), "exit": ("exittime", "fechamento", "saida", "closetime"),
        "direction": ("direction", "lado", "side", "direcao"), "qty": ("qtd", "quantidade", "qty", "contracts", "contratos"),
        "entry_price": ("entryprice", "precocompra", "precoentrada"), "exit_price": ("exitprice", "precovenda", "precosaida"),
        "pnl": ("pnlnet", "resultado", "pnl", "netprofit", "lucroliquido"),
    },
    required=("entry", "exit"),
)
BROKER_BOOK = Layout(
    {
        "entry": ("abertura", "entrada", "entrytime", "datahoraabertura"), "exit": ("fechamento", "saida", "exittime", "datahorafechamento"),
        "direction": ("lado", "direcao", "side"), "qty": ("qtd", "quantidade", "contratos", "qty"),
        "entry_price": ("precocompra", "precoentrada", "entryprice", "buyprice"),
        "exit_price": ("precovenda", "precosaida", "exitprice", "sellprice"),
        "pnl": ("resultado", "pnl", "lucro", "lucroliquido", "resliquido"),
    },
    required=("entry", "exit"),
)
LONG_WORDS = ("c", "compra", "buy", "long", "l")
SHORT_WORDS = ("v", "venda", "sell", "short", "s")


def end_bound(text: str) -> Column:
    """Inclusive end: a bare date means its last second."""
    stamp = F.lit(text.strip()).cast("timestamp_ntz")
    return stamp + F.expr("interval '0 23:59:59' day to second") if len(text.strip()) <= 10 else stamp


def in_range(ts: Column, start: str | None, end: str | None) -> Column:
    ok = F.lit(True)
    if start:
        ok = ok & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end:
        ok = ok & (ts <= end_bound(end))
    return ok


def parse_bars(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Bars of delimited lines before cleaning, with ``file`` and ``line_key`` as order of arrival."""
    rows = read_columns(spark, lines, BAR_LAYOUT)
    stamp = F.when(F.col("has_stamp"), F.col("stamp")).otherwise(
        F.concat_ws(" ", "date", F.when(F.col("has_time"), F.col("time")).otherwise(F.lit("00:00:00")))
    )
    prices = ("open", "high", "low", "close", "volume")
    styled = with_file_styles(rows, prices, stamp=stamp)
    folders = F.split(F.col("file"), "/")
    folder = lambda i: F.regexp_replace(F.element_at(folders, F.lit(i)), "^[a-z]+=", "")
    return styled.select(
        folder(-3).alias("symbol"), folder(-2).alias("timeframe"), file_stamp(stamp, F.col("day_first")).alias("datetime"),
        *[parse_number(F.col(c), F.col(f"style_{c}")).alias(c) for c in prices], "file", "line_key",
    )


def read_bars(
    spark: SparkSession, root: str, symbols: Sequence[str] | None, timeframe: str, start: str | None = None, end: str | None = None,
    zero_prices: bool = False,
) -> DataFrame:
    """Clean bars of ``<root>/<symbol>/<timeframe>/*.csv`` between two inclusive bounds. A load without any row is an error.

    A price of 0 makes a row unusable, unless ``zero_prices`` says that it is one.
    """
    label = timeframe_label(timeframe)
    chosen = "{" + ",".join(f"{s},symbol={s}" for s in symbols) + "}" if symbols else "*"
    folder = "{" + f"{label},timeframe={label}" + "}"
    raw = parse_bars(spark, read_lines(spark, [f"{root}/{chosen}/{folder}/*.csv"]))
    inside = in_range(F.col("datetime"), start, end)
    require_rows(raw.where(inside & F.col("datetime").isNotNull()).select("datetime"), f"{symbols or 'all symbols'} {label} from {start} to {end}")
    return clean_bars(raw, ["file", "line_key"], zero_prices).where(inside)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when a load produced nothing."""
    if df.isEmpty():
        raise ValueError(f"no data for {what}")
    return df


def read_ticks(
    spark: SparkSession, root: str, symbols: Sequence[str], start: str | None = None, end: str | None = None, zero_prices: bool = False
) -> DataFrame:
    """Ticks of ``<SYMBOL>..._DD-MM-YYYY.csv`` files; files of other days are dropped before parsing.

    Ticks at a price of 0 are dropped, unless ``zero_prices`` says that it is one.
    """
    paths = [f"{root}/{s.strip().upper()}*.csv" for s in symbols]
    upper = F.upper("name")
    symbol = F.coalesce(*[F.when(upper.startswith(s.strip().upper()), F.lit(s.strip().upper())) for s in sorted(symbols, key=len, reverse=True)])

    def wanted(name: Column) -> Column:
        day = F.try_to_date(F.regexp_extract(name, r"_(\d{2}-\d{2}-\d{4})\.(?i:csv)$", 1), "dd-MM-yyyy")
        out = day.isNotNull()
        if start:
            out = out & (day >= F.lit(start).cast("timestamp_ntz").cast("date"))
        return out & (day <= end_bound(end).cast("date")) if end else out

    rows = read_columns(spark, read_lines(spark, paths, wanted), TICK_LAYOUT)
    stamp = F.concat_ws(" ", "date", "time")
    styled = with_file_styles(rows, ("price", "volume"), thousands=False, stamp=stamp)
    ticks = styled.select(
        symbol.alias("symbol"), file_stamp(stamp, F.col("day_first")).alias("datetime"), F.col("line_key").alias("seq"),
        parse_number(F.col("price"), F.col("style_price")).alias("price"),
        F.coalesce(parse_number(F.col("volume"), F.col("style_volume")), F.lit(0.0)).alias("volume"),
    )
    priced = (F.col("price") >= 0) if zero_prices else (F.col("price") > 0)
    return ticks.where(F.col("datetime").isNotNull() & priced & in_range(F.col("datetime"), start, end))


def tick_days(spark: SparkSession, root: str, symbol: str) -> DataFrame:
    """(symbol, day) of the tick files present."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(root).select(
        F.element_at(F.split("path", "/"), -1).alias("name")
    )
    day = F.try_to_date(F.regexp_extract("name", r"_(\d{2}-\d{2}-\d{4})\.(?i:csv)$", 1), "dd-MM-yyyy")
    key = symbol.strip().upper()
    return names.where(F.upper("name").startswith(key)).select(F.lit(key).alias("symbol"), day.alias("day")).where("day is not null").distinct()


def read_tradebook(spark: SparkSession, paths: Sequence[str], kind: str = "own") -> DataFrame:
    """Canonical trade book of own trades or of broker operations, numbered by (exit, entry) time."""
    broker = {"own": False, "broker": True}[kind]
    rows = read_columns(spark, read_lines(spark, paths), BROKER_BOOK if broker else OWN_BOOK)
    money = ("qty", "entry_price", "exit_price", "pnl")
    cleaned = rows.withColumns({c: strip_money(F.col(c)) for c in money})
    styled = with_file_styles(cleaned, money)
    value = lambda c: parse_number(F.col(c), F.col(f"style_{c}"))
    word = fold_text(F.coalesce("direction", F.lit("")))
    side = F.when(word.isin(*LONG_WORDS), "long").when(word.isin(*SHORT_WORDS), "short").otherwise("unknown")
    qty = F.coalesce(value("qty"), F.lit(1.0))
    if broker:
        side = F.when(side != "unknown", side).when(qty < 0, "short").otherwise("long")
        qty = F.when(qty == 0, F.lit(1.0)).otherwise(F.abs(qty))
    book = styled.select(
        book_stamp(F.col("entry")).alias("entry_time"), book_stamp(F.col("exit")).alias("exit_time"), side.alias("direction"),
        qty.alias("qty"), value("entry_price").alias("entry_price"), value("exit_price").alias("exit_price"), value("pnl").alias("pnl_net"),
        "line_key", F.lit(0).alias("_all"),
    ).where(F.col("entry_time").isNotNull() & F.col("exit_time").isNotNull())
    numbered = running(book, ["_all"], ["exit_time", "entry_time", "line_key"], time_block(F.col("exit_time")), [Run("_n", "count")])
    return numbered.select(
        (F.col("_n") - 1).alias("trade_id"), "entry_time", "exit_time", "direction", "qty", "entry_price", "exit_price", "pnl_net"
    )
