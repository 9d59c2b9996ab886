"""Series functions and feature layers against step-by-step statements of their rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import folds, ordering
from tidemark.functions import series as S
from tidemark.functions.normal import normal_cdf
from tidemark.functions.quantiles import exact_medians
from tidemark.functions.ordering import max_drawdowns, row_numbers, with_last, with_running
from tidemark.operators import gaps, levels, pools, retracement, signals, structure, zones
from tidemark.plans.config import ExecutionConfig, FeatureConfig, GapConfig, PoolConfig, SessionConfig, ZoneConfig

BARS = "symbol string, timeframe string, time timestamp_ntz, open double, high double, low double, close double, tick_volume double"


def walk(n, seed, step=3.0, symbol="X", hours=1):
    """A random series of bars on a coarse grid, so that ties occur."""
    r, rows, price = random.Random(seed), [], 100.0
    start = datetime(2024, 1, 1)
    for k in range(n):
        o = price
        c = round(o + r.choice([-2, -1, 0, 1, 2]) * r.random() * step, 1)
        rows.append((symbol, "H1", start + timedelta(hours=k * hours), o, round(max(o, c) + r.random() * step / 2, 1), round(min(o, c) - r.random() * step / 2, 1), c, float(r.randint(1, 9))))
        price = c
    return rows


def frame(spark, rows):
    return S.with_bar(spark.createDataFrame(rows, BARS))


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, walk(260, 1) + walk(200, 2, symbol="Y")).persist()


def by_bar(df, symbol="X"):
    return [r.asDict() for r in df.where(F.col("symbol") == symbol).orderBy("bar").collect()]


@pytest.mark.parametrize("method, alpha", [("rma", 1 / 14), ("ema", 2 / 15)])
def test_exponential_atr_follows_the_recursion(bars, method, alpha):
    rows = by_bar(S.add_atr(bars.withColumn("tr", S.true_range()), 14, method))
    y = None
    for r in rows:
        y = r["tr"] if y is None else (1 - alpha) * y + alpha * r["tr"]
        assert r["atr_feature"] == pytest.approx(y, rel=1e-9)


def test_unknown_atr_method_is_refused(bars):
    with pytest.raises(ValueError):
        S.add_atr(bars, 14, "hull")


def test_pivots_allow_ties(spark):
    rows = [("X", "H1", datetime(2024, 1, 1, k), h, h, h - 1, h, 1.0) for k, h in enumerate([1.0, 2.0, 3.0, 3.0, 2.0, 1.0, 0.0])]
    got = [r["p"] for r in by_bar(frame(spark, rows).withColumn("p", S.confirmed_pivot("high", 2, 2, True)))]
    assert got == [False, False, False, False, True, True, False]


def structure_by_steps(rows, n=8, share=0.1):
    """The breaks and trend of the external structure, bar by bar."""
    out, high, low, hl, ll, hb, lb, trend = [], None, None, None, None, False, False, 0
    for i, r in enumerate(rows):
        if r["ext_pivot_high"]:
            p, a = rows[i - n]["high"], rows[i - n]["atr"]
            hl = None if high is None or a is None else "EQH" if abs(p - high) <= a * share else "HH" if p > high else "LH"
            high, hb = p, False
        if r["ext_pivot_low"]:
            p, a = rows[i - n]["low"], rows[i - n]["atr"]
            ll = None if low is None or a is None else "EQL" if abs(p - low) <= a * share else "HL" if p > low else "LL"
            low, lb = p, False
        if (hl, ll) == ("HH", "HL"):
            trend = 1
        elif (hl, ll) == ("LH", "LL"):
            trend = -1
        e = dict.fromkeys(("bos_up", "choch_up", "bos_down", "choch_down", "sweep_high", "sweep_low"), False)
        if high is not None and not hb:
            if r["close"] > high:
                e["bos_up"], e["choch_up"], hb, trend = trend >= 0, trend < 0, True, 1
            elif r["high"] > high:
                e["sweep_high"] = True
        if low is not None and not lb:
            if r["close"] < low:
                e["bos_down"], e["choch_down"], lb, trend = trend <= 0, trend > 0, True, -1
            elif r["low"] < low:
                e["sweep_low"] = True
        out.append(e | {"trend_state": trend})
    return out


def test_structure_equals_its_steps(bars):
    for symbol in "XY":
        rows = by_bar(structure.add_structure(bars), symbol)
        for want, got in zip(structure_by_steps(rows), rows, strict=True):
            assert {k: got[k] for k in want} == want, got["bar"]


def test_zone_life_and_spacing(bars):
    cfg = ZoneConfig(max_width_pips=100, max_stop_pips=100)
    df = zones.with_zone_inputs(bars, cfg)
    found = zones.accepted_zones(zones.zone_candidates(df, 1.0, cfg), cfg).persist()
    z = [r.asDict() for r in found.orderBy("symbol", "side", "zone_id").collect()]
    assert z
    for a, b in zip(z, z[1:]):
        if (a["symbol"], a["side"]) == (b["symbol"], b["side"]):
            assert b["created"] - a["created"] >= cfg.spacing
    alive = {(r["symbol"], r["side"], r["zone_id"], r["bar"]): r["retests"] for r in zones.zone_lifecycle(df, found, cfg).where("alive").collect()}
    want = {}
    data = {s: by_bar(df, s) for s in "XY"}
    for one in z:
        before, retests = False, 0
        for r in data[one["symbol"]][one["created"] : one["created"] + cfg.max_age + 1]:
            if r["atr"] and r["atr"] > 0:
                inside = r["high"] >= one["bottom"] and r["low"] <= one["top"]
                if r["bar"] > one["created"] and inside and not before:
                    retests += 1
                slack = cfg.penetration_atr * r["atr"]
                broken = r["close"] < one["bottom"] - slack if one["side"] == "demand" else r["close"] > one["top"] + slack
                if retests > cfg.max_retests or broken:
                    break
                before = inside
            want[one["symbol"], one["side"], one["zone_id"], r["bar"]] = retests
    assert alive == want


def zoned(bars):
    cfg = ZoneConfig(max_width_pips=100, max_stop_pips=100)
    return zones.add_zones(structure.add_structure(bars).drop("atr"), 1.0, cfg)


def test_gap_fill_equals_its_steps(bars):
    cfg = GapConfig(max_age=5)
    rows = by_bar(gaps.add_gaps(zoned(bars), cfg))
    key, tracked, filled = None, [], None
    for i, r in enumerate(rows):
        own = (r["bar"] - r["demand_zone_age"], r["demand_zone_bottom"], r["demand_zone_top"]) if r["sd_demand_valid"] else None
        if own != key:
            key, tracked, filled = own, [], None
        hit = False
        if key is not None:
            tracked = [g for g in tracked if i - g[0] <= cfg.max_age]
            slack = max(0.0, 0.1 * r["atr"]) if r["atr"] and r["atr"] > 0 else 0.0
            if i >= 2 and r["low"] - rows[i - 2]["high"] > 0 and not r["sd_demand_touched"] and filled is None and r["low"] >= r["demand_zone_entry"] - slack:
                tracked.append((i, rows[i - 2]["high"], r["low"]))
            if filled is None:
                filled = next((g for g in reversed(tracked) if i > g[0] and r["high"] >= g[1] and r["low"] <= g[2]), None)
                hit = filled is not None
        assert (r["bullish_imbalance_filled"], r["imbalance_long_valid"]) == (hit, key is not None and filled is not None), i
        shown = filled or (tracked[-1] if key is not None and tracked else None)
        assert r["active_bullish_imbalance_low"] == (shown[1] if shown else None), i


def test_legs_ignore_a_low_of_the_same_bar(spark):
    rows = walk(6, 3)
    df = frame(spark, rows).withColumns({"ext_swing_high": F.expr("case bar when 1 then 10.0D when 4 then 12.0D end"), "ext_swing_low": F.expr("case bar when 2 then 5.0D when 4 then 6.0D end")})
    got = by_bar(retracement.add_retracement(df))
    assert [r["fib_bull_impulse_low"] for r in got] == [None] * 6
    assert [r["fib_bear_impulse_high"] for r in got] == [None, None, 10.0, 10.0, 10.0, 10.0]
    assert [r["fib_bear_impulse_low"] for r in got] == [None, None, 5.0, 5.0, 6.0, 6.0]


def test_level_clusters_drift_with_their_mean(spark):
    row = spark.range(1).select(levels.cluster(F.array(*map(F.lit, [1.0, 1.4, 1.6, 3.0])), F.lit(0.45), 1).alias("c"), levels.cluster(F.array(*map(F.lit, [1.0, 1.4, 1.6, 3.0])), F.lit(0.45), 2).alias("d")).first()
    assert [round(x, 6) for x in row["c"]] == [round(4 / 3, 6), 3.0]
    assert [round(x, 6) for x in row["d"]] == [round(4 / 3, 6)]


def test_a_swept_pool_is_used_once():
    side = pools.Side(1, PoolConfig(tolerance=0.5, sweep_bars=2))
    key = (0, 9.0, 11.0)
    assert side.step(0, 10.0, key, 12, 11, 11.5, 0) == (10.0, False)
    assert side.step(1, 10.4, key, 12, 11, 11.5, 0) == (pytest.approx(10.2), False)
    assert side.step(2, None, key, 12, 10, 11.5, 0) == (pytest.approx(10.2), True)
    assert side.step(3, None, key, 12, 9, 11.5, 0) == (None, True)
    assert side.step(5, None, key, 12, 9, 11.5, 0) == (None, False)


def test_features_do_not_see_the_future(spark, bars):
    names = ["bar", "trend_state", "bos_up", "demand_zone_entry", "sd_demand_valid", "long_signal"]
    whole = by_bar(signals.add_signals(zoned(bars)).select("symbol", *names))
    cut = by_bar(signals.add_signals(zoned(frame(spark, walk(260, 1)[:150]))).select("symbol", *names))
    assert cut == whole[:150]


def test_running_values_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 16)
    monkeypatch.setattr(ordering, "GROUP", 4)
    r = random.Random(5)
    values = [r.randint(-5, 5) for _ in range(200)]
    df = spark.createDataFrame([(k, v, v if k % 3 else None) for k, v in enumerate(values, 1)], "row_id long, v int, some int")
    got = {x["row_id"]: x for x in with_last(with_running(df, {"cum": F.col("v"), "twice": F.col("v") * 2}, "row_id", None, {"cum": "peak"}), F.col("some"), "row_id", "known").collect()}
    cum, peak, worst, known = 0, None, 0, None
    for k, v in enumerate(values, 1):
        cum += v
        peak = cum if peak is None else max(peak, cum)
        worst = max(worst, peak - cum)
        known = v if k % 3 else known
        assert (got[k]["cum"], got[k]["twice"], got[k]["peak"], got[k]["known"]) == (cum, 2 * cum, peak, known)
    falls = max_drawdowns(df, {"a": F.col("v").cast("double"), "b": F.lit(0.0)}, "row_id").first()
    assert (falls["a"], falls["b"]) == (worst, 0)
    numbered = row_numbers(df.repartition(7), ["v", "row_id"], "n").orderBy("n").collect()
    assert [x["n"] for x in numbered] == list(range(1, 201))
    assert [(x["v"], x["row_id"]) for x in numbered] == sorted((v, k) for k, v in enumerate(values, 1))


def test_keyed_running_values_with_null_keys(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 8)
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), k, r.random()) for k in range(150)]
    df = spark.createDataFrame(rows, "key string, at int, v double").repartition(5)
    numbered = row_numbers(df, [F.desc("v")], "n", ["key"], "size")
    got = with_running(numbered, {"cum": F.col("v")}, "n", ["key"]).collect()
    assert len(got) == 150
    for key in ("a", "b", None):
        want = sorted((v for k, _, v in rows if k == key), reverse=True)
        own = sorted((x for x in got if x["key"] == key), key=lambda x: x["n"])
        assert [x["n"] for x in own] == list(range(1, len(want) + 1)) and {x["size"] for x in own} == {len(want)}
        assert [x["cum"] for x in own] == pytest.approx([sum(want[: k + 1]) for k in range(len(want))])
    assert row_numbers(df.where("false"), ["v"]).count() == 0


@pytest.mark.parametrize("parts", [None, 6])
def test_row_numbers_lose_no_rows_with_carried_columns(spark, parts):
    raw = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    if parts:
        raw = raw.repartition(parts)
    out = row_numbers(raw, ["l_shipdate", "l_orderkey", "l_linenumber"])
    row = out.agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("ids"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.sum("l_tax").alias("tax")).first()
    assert (row["n"], row["ids"], row["low"], row["high"]) == (600_000, 600_000, 1, 600_000)
    assert row["tax"] == pytest.approx(raw.agg(F.sum("l_tax")).first()[0])
    # later rows don't lie before earlier ones
    w = Window.orderBy("row_id")
    assert out.select("row_id", "l_shipdate", F.lag("l_shipdate").over(w).alias("before")).where("l_shipdate < before").count() == 0
    spark.catalog.clearCache()


def test_normal_distribution(spark):
    from statistics import NormalDist

    zs = [-6.0, -3.5, -1.0, 0.0, 0.3, 2.0, 3.4, 3.6, 7.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(NormalDist().cdf(r["z"]), abs=1e-12)


def test_settings_are_checked_and_named():
    for make in (lambda: ZoneConfig(invalidation="hope"), lambda: SessionConfig(sessions=(("A", 8, 8),)), lambda: ExecutionConfig(runner="maybe"), lambda: PoolConfig(tolerance=-1)):
        with pytest.raises(ValueError):
            make()
    assert FeatureConfig().signature() == FeatureConfig().signature() != FeatureConfig(pip=0.01).signature()
    assert len(FeatureConfig().signature()) == 16


@pytest.mark.parametrize("size", [7, 50, 1 << 16])
def test_pools_in_chunks_of_any_size(bars, monkeypatch, size):
    """The state that is handed on from chunk to chunk loses nothing."""
    df = zones.add_zones(structure.add_structure(bars), 0.1, ZoneConfig(max_width_pips=1e9, max_stop_pips=1e9, body_atr=0.2, range_atr=0.3, base_range_atr=9.0, width_atr=(0.0, 9.0)))
    cfg = PoolConfig(tolerance=1.0, two_touches=False)
    monkeypatch.setattr(folds, "CHUNK", size)
    out = pools.add_pools(df, cfg)
    for symbol in ("X", "Y"):
        rows = by_bar(out, symbol)
        assert any(r["liquidity_pool_low"] is not None for r in rows) or symbol == "Y"
        sides = [pools.Side(1, cfg), pools.Side(-1, cfg)]
        for r in rows:
            tolerance = max(cfg.tolerance, cfg.proximity_atr * (r["atr"] or 0))
            for side, name, swing in ((sides[0], "demand", "low"), (sides[1], "supply", "high")):
                key = (r["bar"] - r[f"{name}_zone_age"], r[f"{name}_zone_bottom"], r[f"{name}_zone_top"]) if r[f"sd_{name}_valid"] else None
                price, valid = side.step(r["bar"], r[f"ext_swing_{swing}"], key, r["high"], r["low"], r["close"], tolerance)
                assert (r[f"liquidity_pool_{swing}"], r[f"liquidity_{'long' if side.sign > 0 else 'short'}_valid"]) == (price, valid)


@pytest.mark.parametrize("size", [10, 1 << 16])
def test_spacing_of_dense_candidates(spark, monkeypatch, size):
    monkeypatch.setattr(folds, "CHUNK", size)
    rows = spark.range(120).select(F.lit("X").alias("symbol"), F.lit("H1").alias("timeframe"), F.lit("demand").alias("side"), (F.col("id") * 3 % 97).alias("created"), F.col("id").alias("pivot_bar"), *[F.col("id").alias(c) for c in ("base_start", "base_end", "departure")], *[F.lit(1.0).alias(c) for c in ("zone_atr", *zones.ZONE)])
    got = [(r["created"], r["pivot_bar"]) for r in zones.accepted_zones(rows, ZoneConfig(spacing=8)).orderBy("zone_id").collect()]
    want, last = [], None
    for created, pivot in sorted((k * 3 % 97, k) for k in range(120)):
        if last is None or created - last >= 8:
            want.append((created, pivot))
            last = created
    assert got == want


def test_spacing_is_linear(spark):
    """A hundred thousand candidates one bar apart: one long chain."""
    rows = spark.range(100_000).select(F.lit("X").alias("symbol"), F.lit("H1").alias("timeframe"), F.lit("supply").alias("side"), F.col("id").alias("created"), F.col("id").alias("pivot_bar"), *[F.col("id").alias(c) for c in ("base_start", "base_end", "departure")], *[F.lit(1.0).alias(c) for c in ("zone_atr", *zones.ZONE)])
    assert zones.accepted_zones(rows, ZoneConfig(spacing=7)).agg(F.count("*"), F.max("created")).first() == (14_286, 99_995)


@pytest.mark.parametrize("longest", [1, 5, 61])
def test_interval_join_moves_a_span_twice_at_most(spark, longest):
    r = random.Random(longest)
    spans = [("X", k, (a := r.randrange(-20, 300)), a + r.randrange(-3, longest)) for k in range(80)]
    bars = spark.range(200).select(F.lit("X").alias("symbol"), F.col("id").alias("bar"))
    table = spark.createDataFrame(spans, "symbol string, k int, a long, b long")
    got = sorted((x["k"], x["bar"]) for x in S.interval_join(bars, table, ["symbol"], F.col("a"), F.col("b"), longest).collect())
    assert got == sorted((k, bar) for _, k, a, b in spans for bar in range(max(a, 0), min(b, 199) + 1))


@pytest.mark.parametrize("accuracy", [10, 50, 2000])
def test_exact_medians(spark, monkeypatch, accuracy):
    """Groups of many sizes with ties, outliers, negative numbers and nulls; brackets much narrower than the groups."""
    from statistics import median

    from tidemark.functions import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    r = random.Random(accuracy)
    kinds = [lambda: r.random(), lambda: r.choice((1.0, 2.0, 2.5)), lambda: 10 ** r.uniform(-9, 9) * r.choice((-1, 1)), lambda: 7.0, lambda: float(r.randrange(50))]
    rows = [(f"{k}-{n}", r.choice((None, x())) if k == 1 and n > 3 else x()) for k, x in enumerate(kinds) for n in (1, 2, 3, 10, 61, 400, 3001) for _ in range(n)]
    rows += [("none", None), (None, 3.0), (None, 4.0)]
    got = {x["k"]: x["m"] for x in exact_medians(spark.createDataFrame(rows, "k string, v double").repartition(7), F.col("v"), ["k"], "m").collect()}
    own = {}
    for k, v in rows:
        if v is not None:
            own.setdefault(k, []).append(v)
    assert got == {k: median(v) for k, v in own.items()}
