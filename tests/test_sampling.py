"""Draws of parameters recomputed one by one from the published hash."""

import json
import math
import struct

import xxhash

from checks import sweep_checks
from checks.registry import QUERIES
from tidebar.operators import sweep as W


def unit(seed, sample, name):
    state = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
    state = xxhash.xxh64(struct.pack("<q", sample), seed=state).intdigest()
    return (xxhash.xxh64(name.encode(), seed=state).intdigest() & ((1 << 53) - 1)) / float(1 << 53)


def whole(seed, sample, name, low, high):
    return low + math.floor(unit(seed, sample, name) * (high - low))


def breakout(seed, sample):
    stop = whole(seed, sample, "stop_points", 120, 901)
    ratio = 1.0 + unit(seed, sample, "rr") * (2.6 - 1.0)
    return {"lookback": whole(seed, sample, "lookback", 8, 81), "min_range_points": whole(seed, sample, "min_range_points", 80, 1601),
            "stop_points": stop, "take_points": int(max(stop * ratio, stop + 50))}


def test_draws_follow_the_hash_and_each_other(spark):
    ids = spark.range(200).selectExpr("id * 7919 - 400 as sample_no")
    got = {r.sample_no: r.asDict() for r in W.sample_parameters(ids, "breakout_range", 11).collect()}
    assert got == {n: {"sample_no": n, **breakout(11, n)} for n in got} and len(got) == 200
    for row in W.sample_parameters(ids, "ema_pullback", 11).collect():
        fast = whole(11, row.sample_no, "ema_fast", 10, 41)
        assert (row.ema_fast, row.ema_slow) == (fast, whole(11, row.sample_no, "ema_slow", max(fast + 40, 80), 301))
        assert row.use_adx == (whole(11, row.sample_no, "use_adx", 0, 2) == 1)


def test_all_samplers_are_checked():
    assert set(sweep_checks.BOUNDS) == set(W.SAMPLERS)


def test_cycles_take_seeds_first_then_distinct_draws(spark, tmp_path):
    events = spark.range(60).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as ts", "id % 5 as user_id", "'click' as event_type",
                                        "cast(id * 37 % 90 as double) as value", "concat('{\"k\": ', cast(id % 9 as string), '}') as props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["w14_cycle_seeds"](spark, str(tmp_path)).collect()
    best: dict = {}
    for i in range(60):  # the bank: best score per set, the first on ties
        score, k = round(float(i * 37 % 90) - 50.0, 2), i % 9
        if k not in best or score > best[k][0]:
            best[k] = (score, i)
    top = sorted(best.items(), key=lambda e: (-e[1][0], json.dumps({"k": e[0]})))[:5]
    for cycle in range(3):
        want = {json.dumps({"k": k}, separators=(",", ":")): (0, i) for k, (_, i) in top}
        for n in range(60):
            text = json.dumps(breakout(42 + cycle * 1000, n), separators=(",", ":"), sort_keys=True)
            want.setdefault(text, (1, n))
        assert {r.params_json: (r.origin, r.sample_no) for r in got if r.cycle == cycle} == want
