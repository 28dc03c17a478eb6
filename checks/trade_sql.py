"""SQL twin of the trade chain: candidates, first exits, sequential admission, equity."""

from __future__ import annotations

from checks.sql import with_
from tidebar.operators.params import ExecutionSettings

SEC = "(hour({t}) * 3600 + minute({t}) * 60 + second({t}))"


def hhmm(text: str | None) -> str:
    if not text:
        return "NULL::INTEGER"
    h, m = text.split(":")[:2]
    return str(int(h) * 3600 + int(m) * 60)


def params_cte(sets: list[dict], base: ExecutionSettings) -> str:
    rows = []
    for i, p in enumerate(sets):
        g = lambda k, d: p.get(k, d)
        rows.append(
            f"({i}::BIGINT, {float(g('stop_points', base.stop_points))}::DOUBLE, {float(g('take_points', base.take_points))}::DOUBLE, "
            f"{float(g('break_even_trigger_points', base.break_even_trigger_points))}::DOUBLE, {float(g('break_even_lock_points', base.break_even_lock_points))}::DOUBLE, "
            f"{hhmm(g('session_start', base.session_start))}, {hhmm(g('session_end', base.session_end))}, {str(bool(g('close_on_session_end', base.close_on_session_end))).lower()}, "
            f"{int(g('max_consecutive_losses_per_day', base.max_consecutive_losses_per_day))}, {str(bool(g('enable_daily_limits', base.enable_daily_limits))).lower()}, "
            f"{float(g('daily_loss_limit', base.daily_loss_limit))}::DOUBLE, {float(g('daily_profit_target', base.daily_profit_target))}::DOUBLE)"
        )
    return "p AS (SELECT * FROM (VALUES " + ",\n ".join(rows) + ") v(param_id, stop, take, be, lk, s0, s1, fl, maxl, dl, ll, pt))"


def breakout_sig(sets: list[dict], source: str = "idx", part: str = "symbol") -> str:
    """Signals of the breakout rule for several lookbacks."""
    values = ", ".join(f"({i}::BIGINT, {int(s['lookback'])}, {float(s['min_range_points'])})" for i, s in enumerate(sets))
    ns = sorted({int(s["lookback"]) for s in sets})
    arms = " UNION ALL ".join(
        f"SELECT {part}, bar_idx, close, {n} AS n, CASE WHEN count(high) OVER f{n} = {n} THEN max(high) OVER f{n} END AS hi, CASE WHEN count(low) OVER f{n} = {n} THEN min(low) OVER f{n} END AS lo "
        f"FROM {source} WINDOW f{n} AS (PARTITION BY {part} ORDER BY bar_idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in ns
    )
    return f"""sp AS (SELECT * FROM (VALUES {values}) v(param_id, n, floor)), prior AS ({arms}),
sig AS (SELECT {part}, bar_idx, param_id, CASE WHEN close < lo AND hi - lo >= floor THEN -1 WHEN close > hi AND hi - lo >= floor THEN 1 ELSE 0 END AS signal FROM prior JOIN sp USING (n))"""


def slip(rng: str, t: str, base: ExecutionSettings, s0: str) -> str:
    out = f"{max(0.0, base.slippage_points)}::DOUBLE"
    if base.slippage_model == "range_scaled":
        out = f"({out} + {rng} * {base.slippage_range_factor})"
    if base.open_auction_minutes > 0:
        out = f"(CASE WHEN {auction(t, base, s0)} THEN {out} * {base.open_auction_slippage_multiplier} ELSE {out} END)"
    return out


def auction(t: str, base: ExecutionSettings, s0: str) -> str:
    if base.open_auction_minutes <= 0:
        return "false"
    since = f"(hour({t}) * 60 + minute({t}) - {s0} // 60)"
    return f"coalesce({since} >= 0 AND {since} < {base.open_auction_minutes}, false)"


def chain(base: ExecutionSettings, source: str = "idx", part: str = "symbol", admit: bool = True) -> str:
    """CTEs cand, ex (priced candidates) and tr (admitted trades); needs ``sig`` and ``p``."""
    nxt = base.entry_mode == "next_open"
    e = "n" if nxt else "b"
    price = "n.open" if nxt else "b.close"
    first = "n.bar_idx" if nxt else "b.bar_idx + 1"
    sec = SEC.format(t=f"{e}.datetime")
    sides = " OR ".join((["s.signal > 0"] if base.allow_long else []) + (["s.signal < 0"] if base.allow_short else []))
    bsec = SEC.format(t="b.datetime")
    same = lambda a, b: " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in part.split(","))
    key = ", ".join(f"c.{c.strip()}" for c in part.split(","))
    outside = f"(c.fl AND (coalesce({bsec} < c.s0, false) OR coalesce({bsec} >= c.s1, false)))"
    shit = lambda stop: f"(CASE WHEN c.side > 0 THEN b.low <= {stop} ELSE b.high >= {stop} END)"
    thit = "(CASE WHEN c.side > 0 THEN b.high >= c.tk ELSE b.low <= c.tk END)"
    cost = f"{base.fixed_cost_per_trade + base.cost_per_contract * base.contracts}::DOUBLE"
    if base.cost_model == "range_scaled":
        cost = f"({cost} + greatest(0, (entry_range + exit_range) / 2.0) * {base.cost_range_factor * base.point_value * base.contracts})"
    if base.open_auction_minutes > 0:
        cost = f"(CASE WHEN entry_auction OR {auction('exit_time', base, 's0')} THEN {cost} * {base.open_auction_cost_multiplier} ELSE {cost} END)"
    pk = ", ".join(c.strip() for c in part.split(","))
    text = f"""cand AS (SELECT {', '.join('s.' + c.strip() for c in part.split(','))}, s.param_id, s.signal AS side, s.bar_idx AS sig_idx, CAST(b.datetime AS DATE) AS sig_day, {e}.bar_idx AS entry_idx, {first} AS first_idx,
 {e}.datetime AS entry_time, {price} + s.signal * {slip(f'greatest({e}.high - {e}.low, 0)', f'{e}.datetime', base, 'p.s0')} AS entry_price, greatest({e}.high - {e}.low, 0) AS entry_range,
 {auction(f'{e}.datetime', base, 'p.s0')} AS entry_auction, p.* EXCLUDE (param_id)
 FROM sig s JOIN p USING (param_id) JOIN {source} b ON {same('s', 'b')} AND s.bar_idx = b.bar_idx {'JOIN ' + source + ' n ON ' + same('s', 'n') + ' AND n.bar_idx = s.bar_idx + 1' if nxt else ''}
 WHERE s.signal <> 0 AND ({sides}) AND coalesce({sec} >= p.s0, true) AND coalesce({sec} < p.s1, true)),
lv AS (SELECT *, entry_price - side * stop AS st, entry_price + side * take AS tk, CASE WHEN be > 0 THEN entry_price + side * be END AS tg,
 CASE WHEN side > 0 THEN greatest(entry_price - side * stop, entry_price + side * lk) ELSE least(entry_price - side * stop, entry_price + side * lk) END AS st1 FROM cand),
h0 AS (SELECT {key}, c.param_id, c.sig_idx, min(b.bar_idx) FILTER ({outside} OR {shit('c.st')} OR {thit}) AS x0,
 min(b.bar_idx) FILTER (CASE WHEN c.side > 0 THEN b.close >= c.tg ELSE b.close <= c.tg END) AS arm
 FROM lv c JOIN {source} b ON {same('c', 'b')} AND b.bar_idx >= c.first_idx GROUP BY ALL),
l1 AS (SELECT c.*, x0, CASE WHEN arm < coalesce(x0, 9000000000) THEN arm END AS armed FROM lv c LEFT JOIN h0 USING ({pk}, param_id, sig_idx)),
h1 AS (SELECT {key}, c.param_id, c.sig_idx, min(b.bar_idx) AS x1 FROM l1 c JOIN {source} b ON {same('c', 'b')} AND b.bar_idx > c.armed
 AND ({outside} OR {shit('c.st1')} OR {thit}) GROUP BY ALL),
l2 AS (SELECT c.*, CASE WHEN armed IS NULL THEN x0 ELSE x1 END AS hit, CASE WHEN armed IS NULL THEN st ELSE st1 END AS fst FROM l1 c LEFT JOIN h1 USING ({pk}, param_id, sig_idx)),
lastb AS (SELECT {pk}, max(bar_idx) AS lb FROM {source} GROUP BY {pk}),
l3 AS (SELECT c.*, b.bar_idx AS exit_idx, b.datetime AS exit_time, CAST(b.datetime AS DATE) AS exit_day, greatest(b.high - b.low, 0) AS exit_range,
 CASE WHEN hit IS NULL THEN 'end_of_data' WHEN {outside} THEN 'session_end' WHEN {shit('c.fst')} AND {thit} THEN 'stop_and_take_hit_conservative_stop' WHEN {shit('c.fst')} THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason,
 CASE WHEN hit IS NULL THEN b.close WHEN {outside} THEN b.open WHEN {shit('c.fst')} THEN c.fst ELSE c.tk END AS raw
 FROM l2 c JOIN lastb l USING ({pk}) JOIN {source} b ON {same('c', 'b')} AND b.bar_idx = coalesce(c.hit, l.lb)),
ex0 AS (SELECT *, raw - side * {slip('exit_range', 'exit_time', base, 's0')} AS exit_price, {cost} AS costs FROM l3),
ex AS (SELECT *, (exit_price - entry_price) * side AS pnl_points, (exit_price - entry_price) * side * {base.point_value * base.contracts} AS pnl_gross,
 (exit_price - entry_price) * side * {base.point_value * base.contracts} - costs AS pnl_net, greatest(1, exit_idx - entry_idx + 1) AS duration_bars FROM ex0)"""
    if not admit:
        return text
    return text + f""",
num AS (SELECT *, row_number() OVER (PARTITION BY {pk}, param_id ORDER BY sig_idx) AS rn FROM ex),
walk AS (SELECT {pk}, param_id, rn, exit_idx + (exit_reason = 'end_of_data')::INT AS ox, exit_day AS od, pnl_net AS op, sig_day AS dy, 0 AS stk, 0.0::DOUBLE AS real, false AS ss, false AS ls, true AS taken FROM num WHERE rn = 1
 UNION ALL SELECT {', '.join('q.' + c.strip() for c in part.split(','))}, q.param_id, q.rn, CASE WHEN q.adm THEN q.exit_idx + (q.exit_reason = 'end_of_data')::INT WHEN q.closed THEN NULL ELSE q.ox END, CASE WHEN q.adm THEN q.exit_day WHEN q.closed THEN NULL ELSE q.od END,
  CASE WHEN q.adm THEN q.pnl_net WHEN q.closed THEN NULL ELSE q.op END, q.sig_day, q.stk, q.real, q.ss, q.ls, q.adm FROM (
  SELECT z.*, (z.closed OR z.ox IS NULL) AND NOT z.ss AND NOT z.ls AS adm FROM (
   SELECT y.* REPLACE (CASE WHEN y.sig_day <> y.d1 THEN 0 ELSE y.stk END AS stk, CASE WHEN y.sig_day <> y.d1 THEN 0.0 ELSE y.real END AS real,
     CASE WHEN y.sig_day <> y.d1 THEN false ELSE y.ss OR (y.maxl > 0 AND y.stk >= y.maxl AND y.closed) END AS ss,
     CASE WHEN y.sig_day <> y.d1 THEN false ELSE y.ls OR (y.closed AND y.dl AND ((y.ll > 0 AND y.real <= -y.ll) OR (y.pt > 0 AND y.real >= y.pt))) END AS ls) FROM (
    SELECT x.* REPLACE (CASE WHEN NOT x.closed THEN x.stk0 WHEN x.op < 0 THEN (CASE WHEN x.od <> x.dy THEN 0 ELSE x.stk0 END) + 1 WHEN x.op > 0 THEN 0 ELSE (CASE WHEN x.od <> x.dy THEN 0 ELSE x.stk0 END) END AS stk,
      CASE WHEN NOT x.closed THEN x.real0 ELSE (CASE WHEN x.od <> x.dy THEN 0.0 ELSE x.real0 END) + x.op END AS real,
      CASE WHEN x.closed AND x.od <> x.dy THEN false ELSE x.ss END AS ss, CASE WHEN x.closed AND x.od <> x.dy THEN false ELSE x.ls END AS ls),
      CASE WHEN x.closed THEN x.od ELSE x.dy END AS d1 FROM (
     SELECT n.*, w.ox, w.od, w.op, w.dy, w.stk AS stk0, w.real AS real0, w.stk AS stk, w.real AS real, w.ss AS ss, w.ls AS ls, coalesce(w.ox <= n.sig_idx, false) AS closed
     FROM walk w JOIN num n ON {same('w', 'n')} AND w.param_id = n.param_id AND n.rn = w.rn + 1) x) y) z) q),
tr AS (SELECT n.* FROM num n JOIN walk w USING ({pk}, param_id, rn) WHERE w.taken)"""


def equity_ctes(base: ExecutionSettings, source: str = "idx", part: str = "symbol") -> str:
    pk = ", ".join(c.strip() for c in part.split(","))
    same = " AND ".join(f"t.{c.strip()} = b.{c.strip()}" for c in part.split(","))
    return f""",
grid AS (SELECT b.*, p.param_id FROM {source} b, p),
net AS (SELECT {pk}, param_id, exit_idx AS bar_idx, sum(pnl_net) AS net FROM tr GROUP BY ALL),
flo AS (SELECT {', '.join('b.' + c.strip() for c in part.split(','))}, t.param_id, b.bar_idx, sum((b.close - t.entry_price) * t.side * {base.point_value * base.contracts}) AS fl
 FROM tr t JOIN {source} b ON {same} AND b.bar_idx >= t.entry_idx AND b.bar_idx < t.exit_idx GROUP BY ALL),
eq AS (SELECT {pk}, param_id, bar_idx, datetime, {base.initial_capital} + sum(coalesce(net, 0)) OVER (PARTITION BY {pk}, param_id ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS cash,
 {base.initial_capital} + sum(coalesce(net, 0)) OVER (PARTITION BY {pk}, param_id ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) + coalesce(fl, 0) AS equity
 FROM grid LEFT JOIN net USING ({pk}, param_id, bar_idx) LEFT JOIN flo USING ({pk}, param_id, bar_idx))"""


def trades_sql(sig: str, sets: list[dict], base: ExecutionSettings, select: str, equity: bool = False, admit: bool = True) -> str:
    extra = sig + ",\n" + params_cte(sets, base) + ",\n" + chain(base, admit=admit) + (equity_ctes(base) if equity else "")
    return with_("idx", extra=extra, recursive=True) + select
