"""Symbol metadata: names, pip sizes and volume rules, as a small dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive(x: Column) -> Column:
    """A positive number or NULL."""
    y = x.try_cast("double")
    return F.when(y > 0, y)


def fallback_pip(symbol: Column) -> Column:
    """Pip size by name: yen pairs 0.01, gold 0.10, else 0.0001."""
    name = F.upper(symbol)
    return F.when(name.contains("JPY"), F.lit(0.01)).when(name.contains("XAU") | name.contains("GOLD"), F.lit(0.10)).otherwise(F.lit(0.0001))


def pip_size(symbol: Column, digits: Column, point: Column, tick_size: Column) -> Column:
    """Pip size from broker metadata, by the number of digits where a point is given."""
    p, t = positive(point), positive(tick_size)
    known = F.when(digits.isin(3, 5), 10 * p).when(digits.isNotNull(), p).otherwise(F.coalesce(t, p))
    return F.when(p.isNotNull(), known).otherwise(fallback_pip(symbol))


def build_specs(raw: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """Normalised metadata with the source of the pip size: override (exact name, then prefix), broker or fallback."""
    override = F.lit(None).cast("double")
    for name, value in sorted((overrides or {}).items(), key=lambda x: len(x[0])):
        override = F.when(F.upper("symbol").startswith(name.upper()), F.lit(float(value))).otherwise(override)
    for name, value in (overrides or {}).items():
        override = F.when(F.upper("symbol") == name.upper(), F.lit(float(value))).otherwise(override)
    numbers = {c: positive(F.col(c)) if c in raw.columns else F.lit(None).cast("double") for c in ("point", "tick_size", "tick_value", "contract_size", "volume_min", "volume_max", "volume_step")}
    digits = F.col("digits").try_cast("int") if "digits" in raw.columns else F.lit(None).cast("int")
    out = raw.withColumns(numbers | {"digits": digits, "tm_o": override})
    given = pip_size(F.col("symbol"), F.col("digits"), F.col("point"), F.col("tick_size"))
    source = F.when(F.col("tm_o").isNotNull(), "override").when(F.col("point").isNotNull(), "broker").otherwise("fallback")
    return out.withColumns({"pip_size": F.coalesce("tm_o", given), "source": source}).drop("tm_o")


def normalise_symbol(name: Column) -> Column:
    """Gold and silver variants by their metal, else the leading six letters, else the name."""
    up = F.upper(F.trim(name))
    six = F.regexp_extract(up, "^([A-Z]{6})", 1)
    return F.when(up.contains("XAU") | up.contains("GOLD"), "XAUUSD").when(up.contains("XAG") | up.contains("SILVER"), "XAGUSD").when(six != "", six).otherwise(up)


def resolve_symbols(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """Broker name for each wanted symbol: the exact one, else of those that hold it the closest that starts with it, else the closest.

    ``listed`` is a catalogue of names; closeness is edit distance, then the name.
    Names are cut to every part that is as long as some wanted symbol, so the
    search for holders is an equi-join.
    """
    w = wanted.select(F.upper(F.trim("symbol")).alias("symbol")).where("symbol <> ''").distinct()
    sizes = w.agg(F.collect_set(F.length("symbol")).alias("sizes"))  # some small numbers
    cat = listed.select(F.col("name"), F.upper("name").alias("up")).crossJoin(F.broadcast(sizes))
    part = F.flatten(F.transform("sizes", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("up") - n + 1)), lambda k: F.substr(F.col("up"), k, n))))
    cat = cat.select("name", "up", F.explode(F.array_distinct(part)).alias("symbol"))
    near = w.join(cat, "symbol")
    rank = F.struct((F.col("up") != F.col("symbol")).alias("a"), (~F.col("up").startswith(F.col("symbol"))).alias("b"), F.levenshtein("up", "symbol").alias("c"), F.col("name").alias("d"))
    best = near.groupBy("symbol").agg(F.min_by("name", rank).alias("broker_symbol"), F.count("*").alias("candidates"))
    return w.join(best, "symbol", "left")


def tradable(names: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    """Currency pairs and precious metals, canonical and distinct, preferred ones first."""
    up = F.upper("name")
    fx = up.rlike("^(EUR|GBP|AUD|NZD|USD|CAD|CHF|JPY){2}") | up.rlike("XAU|XAG|GOLD|SILVER")
    out = names.where(fx).select(normalise_symbol(F.col("name")).alias("symbol")).distinct()
    first = F.when(F.col("symbol").isin(preferred or []), 0).otherwise(1)
    return out.orderBy(first, "symbol")


#: Columns of a spec that features and execution read from a bar.
SPEC = ("pip_size", "tick_size", "tick_value", "contract_size", "volume_min", "volume_max", "volume_step")


def attach_specs(bars: DataFrame, specs: DataFrame, few: int = 100_000) -> DataFrame:
    """Add each symbol's spec to its bars; bars without one have nulls, which settings stand in for.

    ``specs`` has a row for each symbol. It is broadcast if it has at most ``few`` rows.
    """
    have = specs.select("symbol", *[c for c in SPEC if c in specs.columns]).dropDuplicates(["symbol"])
    return bars.join(F.broadcast(have) if have.limit(few + 1).count() <= few else have, "symbol", "left")


def pip_of(df: DataFrame, default: float) -> Column:
    """Pip size of each row: the symbol's own where the table has it, else the default."""
    return F.coalesce(F.col("pip_size"), F.lit(float(default))) if "pip_size" in df.columns else F.lit(float(default))
