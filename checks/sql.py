"""Common table expressions shared by the SQL twins."""

from __future__ import annotations

PARTS = {
    "ticks": """ticks AS (SELECT event_type AS symbol, ts AS datetime, event_id AS seq, value AS price, 1.0::DOUBLE AS volume FROM events)""",
    "bars": """bars AS (SELECT symbol, '60m' AS timeframe, datetime, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, seq) AS close, sum(volume) AS volume
  FROM (SELECT symbol, make_timestamp(CAST(ceil(epoch_us(datetime)/3600000000.0) AS BIGINT)*3600000000) AS datetime, price, volume,
        row_number() OVER (PARTITION BY symbol ORDER BY datetime, seq) AS seq FROM ticks) GROUP BY symbol, datetime)""",
    "idx": """idx AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS bar_idx FROM bars)""",
    "trades": """trades AS (SELECT event_type AS strategy, event_id AS trade_id, ts AS entry_time,
  ts + to_minutes(CAST(event_id % 90 + 1 AS INTEGER)) AS exit_time, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
  value AS entry_price, value + CASE WHEN event_id % 2 = 0 THEN round(value - 50.0, 2) + 1.0 ELSE -(round(value - 50.0, 2) + 1.0) END AS exit_price,
  round(value - 50.0, 2) + 1.0 AS pnl_points, round(value - 50.0, 2) + 1.0 AS pnl_gross, 1.0::DOUBLE AS costs,
  round(value - 50.0, 2) AS pnl_net, props FROM events)""",
    "equity": """equity AS (SELECT strategy, exit_time AS datetime, trade_id AS seq,
  100000.0 + sum(pnl_net) OVER (PARTITION BY strategy ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS equity FROM trades)""",
    "windows": """windows AS (SELECT event_type AS strategy, CAST(day(ts) AS INTEGER) AS window_id,
  coalesce(avg(value) FILTER (event_id % 2 = 0), 0.0) AS best_train_score, coalesce(avg(value) FILTER (event_id % 2 = 1), 0.0) - 50.0 AS oos_score,
  sum(round(value - 50.0, 2)) AS oos_net_profit, arg_max(props, event_id) AS best_train_params_json FROM events GROUP BY ALL)""",
    "history": """history AS (SELECT o_orderkey AS run_tag, o_orderdate AS created_at, o_orderstatus AS symbol, CASE WHEN o_custkey % 2 = 0 THEN '5m' ELSE '60m' END AS timeframe,
  o_orderpriority AS strategy, o_totalprice AS score, round(o_totalprice - 150000.0, 2) AS net_profit, (o_custkey % 100)::DOUBLE AS win_rate, round(o_totalprice / 10.0, 3) AS max_drawdown,
  (o_custkey % 40)::DOUBLE AS trade_count, o_orderkey % 6 + 1 AS rank_in_run, '{"b": ' || (o_custkey % 30)::VARCHAR || ', "a": 1}' AS params_json, '{"a":1,"b":' || (o_custkey % 30)::VARCHAR || '}' AS canon FROM orders)""",
    "books": """bk AS (SELECT t.*, e.user_id, row_number() OVER (PARTITION BY trade_id % 2 ORDER BY exit_time, entry_time, trade_id) - 1 AS no,
  CASE WHEN trade_id % 10 = 0 THEN 'unknown' ELSE direction END AS dir FROM trades t JOIN events e ON e.event_id = t.trade_id),
ba AS (SELECT * FROM bk WHERE trade_id % 2 = 0), bb AS (SELECT * FROM bk WHERE trade_id % 2 = 1)""",
    "topk": """topk AS (SELECT event_type AS strategy, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS window_id, event_id AS train_rank, value + 1.0 AS train_score,
  round(value - 50.0, 2) AS test_score, round(value * 2 - 100.0, 2) AS test_net_profit, value AS test_max_drawdown, props AS params_json FROM events)""",
}

NEEDS = {"history": [], "books": ["trades"], "windows": [], "topk": [], "ticks": [], "bars": ["ticks"], "idx": ["bars"], "trades": [], "equity": ["trades"]}


def closure(*names: str) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in NEEDS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return order


def with_(*names: str, extra: str = "", recursive: bool = False) -> str:
    """A WITH clause holding the named expressions (and those they need), then ``extra`` ones."""
    parts = [PARTS[n] for n in closure(*names)]
    if extra:
        parts.append(extra)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def r(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"
