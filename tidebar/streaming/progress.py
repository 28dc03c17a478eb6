"""Progress board from run log lines, in batch or as a stream (inventory R5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers and fields of the progress lines, whose grammar and status words parse_progress reads.
NUMBER = r"([-+]?\d+(?:\.\d+)?)"
FIELDS = ("score", "net_profit", "profit_factor", "partial_score", "partial_net", "train_score")


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def parse_progress(lines: DataFrame) -> DataFrame:
    """(timeframe, strategy, seq, status, fields) of [PROGRESS] and [WARN] lines; ``lines`` has line and seq."""
    line = F.trim("line")
    head = r"^\[PROGRESS\]\s+([^/]+)/(\S+)\s+(.*)$"
    warn = r"^\[WARN\]\s+([^/]+)/([^:]+):"
    is_progress, is_warn = line.rlike(head), line.rlike(warn)
    rest = F.regexp_extract(line, head, 3)
    done, window = rest.startswith("done "), rest.startswith("window ") & F.contains(rest, F.lit("done"))
    sample = rest.startswith("sample ")
    full = rf"score={NUMBER}\s+net={NUMBER}\s+pf={NUMBER}"
    short = rf"score={NUMBER}\s+net={NUMBER}"
    oos_score = _number(rest, rf"oos_score={NUMBER}")
    oos = lambda name: F.when(window & oos_score.isNotNull(), _number(rest, rf"oos_{name}={NUMBER}"))
    plain = lambda name: F.when(sample, _number(rest, rf"{name}={NUMBER}"))
    final_net = F.coalesce(_number(rest, full, 2), _number(rest, short, 2))
    return lines.where(is_progress | is_warn).select(
        F.when(is_progress, F.regexp_extract(line, head, 1)).otherwise(F.regexp_extract(line, warn, 1)).alias("timeframe"),
        F.when(is_progress, F.regexp_extract(line, head, 2)).otherwise(F.trim(F.regexp_extract(line, warn, 2))).alias("strategy"),
        "seq",
        F.when(~is_progress, "Erro").when(done, "Concluida").otherwise("Em andamento").alias("status"),
        F.when(done, F.coalesce(_number(rest, full, 1), _number(rest, short, 1))).alias("score"),
        F.when(done, final_net).when(window, oos("net")).when(sample, plain("net")).alias("net_profit"),
        F.when(done, _number(rest, full, 3)).when(window, oos("pf")).when(sample, plain("pf")).alias("profit_factor"),
        F.when(window, oos_score).alias("partial_score"), oos("net").alias("partial_net"), plain("score").alias("train_score"),
    )


def progress_board(lines: DataFrame) -> DataFrame:
    """Latest status and latest known value of every field per (timeframe, strategy).

    On a stream run it in update or complete mode.
    """
    parsed = parse_progress(lines)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return parsed.groupBy("timeframe", "strategy").agg(latest("status"), *[latest(c) for c in FIELDS])


def ranked_board(board: DataFrame) -> DataFrame:
    """Board ordered by final score, else partial score, then net profit; unknown last."""
    return board.orderBy(F.coalesce("score", "partial_score").desc_nulls_last(), F.col("net_profit").desc_nulls_last())


def pending_board(board: DataFrame, timeframes: list[str], strategies: list[str]) -> DataFrame:
    """Board with a pending row for each configured pair that has not reported."""
    pairs = [(t, s) for t in timeframes for s in strategies]
    wanted = board.sparkSession.createDataFrame(pairs, "timeframe string, strategy string")
    return wanted.join(board, ["timeframe", "strategy"], "full").withColumn("status", F.coalesce("status", F.lit("Pendente")))
