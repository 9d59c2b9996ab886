"""Quality rules learned as a decision list, in DataFrame operations only.

Texts are described by a few statistics. From labelled texts, sequential
covering learns an ordered list of rules: a rule grows as a conjunction of
thresholds on single statistics, by information gain on two thirds of the
labelled rows, and is pruned from its end on the other third. The rows that an
accepted rule covers leave the training table, and the next rule is learned. The
result is an ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import REST, carried, kept_column, place_of, without
from .skew import smallest_hashes
from .storage import drop, stored

#: Statistics that rules may test.
FEATURES = ("n_words", "mean_word", "symbol_share", "repeat_share", "dup_line_share", "line_words", "upper_share", "distinct_share")
#: Most labelled rows to learn from; they are those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
BINS = 32
MAX_RULES, MAX_CONDITIONS = 8, 4
#: An accepted rule covers at least so many rows of each part, of which so many are bad ones.
LEAST_COVER, LEAST_PRECISION = 5, 0.9
BASE_WORDS, BASE_REPEAT_PERCENT = 10, 20

_WINDOW = 5
_WHITE = "[ \\x09-\\x0D]"


def _mixed(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of a table with a text column, and the statistics of its whole texts.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the
    shares of ``FEATURES`` (double; 0 where their divisor is 0). A null text has
    no words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # in steps, so that arrays used several times are made once
    one = docs.select(
        *keep,
        F.array_remove(F.split(text, _WHITE + "+"), "").alias("tm_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("tm_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).alias("tm_upper"),
    )
    words, rest = F.col("tm_words"), [*keep, "n_symbols", "tm_upper"]
    two = one.select(
        *rest,
        F.size("tm_lines").alias("tm_n_lines"),
        F.size(F.array_distinct("tm_lines")).alias("tm_d_lines"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("tm_1"),
    )
    rest += ["tm_n_lines", "tm_d_lines", "word_chars"]
    h, end = F.col("tm_1"), F.size("tm_1")
    pairs = two.select(*rest, h, F.zip_with(h, F.slice(h, 2, end), _mixed).alias("tm_2"))
    fours = pairs.select(*rest, h, F.zip_with("tm_2", F.slice("tm_2", 3, end), _mixed).alias("tm_4"))
    # hashes of windows of five words; what reaches over the end is cut off
    windows = F.slice(F.zip_with("tm_4", F.slice(h, 5, end), _mixed), 1, F.greatest(end - (_WINDOW - 1), F.lit(0)))
    made = fours.select(*rest, end.cast("long").alias("n_words"), F.size(F.array_distinct(h)).alias("tm_d_words"), windows.alias("tm_windows"))
    w = F.col("tm_windows")
    places = F.sort_array(F.transform(w, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    three = made.select(*rest, "n_words", "tm_d_words", F.when(F.size(F.array_distinct(w)) < F.size(w), places).alias("tm_sorted"))
    s = F.col("tm_sorted")
    twice = F.filter(s, lambda e, k: F.get(s, k - 1)["h"].eqNullSafe(e["h"]) | F.get(s, k + 1)["h"].eqNullSafe(e["h"]))
    four = three.select(*rest, "n_words", "tm_d_words", F.sort_array(F.transform(twice, lambda e: e["k"])).alias("tm_twice"))
    t = F.col("tm_twice")
    covered = F.aggregate(F.transform(t, lambda p, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(t, k + 1), p + _WINDOW) - p)), F.lit(0), lambda a, x: a + x)

    def share(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))

    five = four.withColumns({"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), "n_dup_lines": (F.col("tm_n_lines") - F.col("tm_d_lines")).cast("long")})
    n, chars = F.col("n_words"), F.col("word_chars")
    return five.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share(chars, n).alias("mean_word"),
        share(F.col("n_symbols"), chars).alias("symbol_share"),
        share(F.col("n_repeat_words"), n).alias("repeat_share"),
        share(F.col("n_dup_lines"), F.col("tm_n_lines")).alias("dup_line_share"),
        share(n, F.col("tm_n_lines")).alias("line_words"),
        share(F.col("tm_upper"), chars).alias("upper_share"),
        share(F.col("tm_d_words"), n).alias("distinct_share"),
    )


def base_failed() -> Column:
    """The base verdict on a table with statistics."""
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature`` at least (or below) ``threshold``."""

    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


def conjunction(rule: list[Condition]) -> Column:
    """All conditions of a rule."""
    return reduce(lambda a, b: a & b, [c.column() for c in rule])


def verdict(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that holds, from 1; 0 where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(conjunction(rule), F.lit(k)) if out is None else out.when(conjunction(rule), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gain of a condition that leaves p bad and n good rows of p0 and n0."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(table: DataFrame, bins: dict[str, list[float]]) -> list[Condition]:
    """Add the condition of largest gain until no good row is covered or nothing is gained."""
    rule: list[Condition] = []
    live = table
    while len(rule) < MAX_CONDITIONS:
        cells = live.select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in bins])).alias("e"))
        # features x bins rows at most
        counts = cells.groupBy("e.f", "e.b").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")).collect()
        p0 = sum(r["p"] for r in counts if r["f"] == FEATURES[0])
        n0 = sum(r["n"] for r in counts if r["f"] == FEATURES[0])
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for feature, edges in bins.items():
            p_at, n_at = [0] * (len(edges) + 1), [0] * (len(edges) + 1)
            for r in counts:
                if r["f"] == feature:
                    p_at[r["b"]], n_at[r["b"]] = r["p"], r["n"]
            p = n = 0
            for k, edge in enumerate(edges):
                p, n = p + p_at[k], n + n_at[k]  # rows below the edge
                for at_least, own_p, own_n in ((False, p, n), (True, p0 - p, n0 - n)):
                    if own_p >= LEAST_COVER and (g := _gain(own_p, own_n, p0, n0)) > gain:
                        best, gain = Condition(feature, at_least, edge), g
        if best is None:
            break
        rule.append(best)
        live = live.where(best.column())
    return rule


def _prune(table: DataFrame, rule: list[Condition]) -> tuple[list[Condition], int, int]:
    """The beginning of the rule with the best (p - n) / (p + n) on the pruning part, and its p and n."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = conjunction(rule[:k])
        sums += [F.coalesce(F.sum((hit & F.col("bad")).cast("long")), F.lit(0)).alias(f"p{k}"), F.coalesce(F.sum((hit & ~F.col("bad")).cast("long")), F.lit(0)).alias(f"n{k}")]
    row = table.agg(*sums).first()
    value = lambda k: (row[f"p{k}"] - row[f"n{k}"]) / max(1, row[f"p{k}"] + row[f"n{k}"])
    k = max(range(1, len(rule) + 1), key=lambda k: (round(value(k), 9), -k))
    return rule[:k], row[f"p{k}"], row[f"n{k}"]


def learn(labelled: DataFrame, rows: int = TRAIN_ROWS) -> list[list[Condition]]:
    """Learn rules for bad rows from statistics with ``doc_id`` and ``quality`` (0: bad, 1: good).

    At most ``rows`` rows are used. Null labels are left out. Without rows of
    both kinds there are no rules. Equal rows count each time.
    """
    sample = smallest_hashes(labelled.where(F.col("quality").isNotNull()), rows, "doc_id", ["doc_id", *FEATURES])
    sample = stored(sample.select((F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) == 0).alias("pruning"), *[F.col(f).cast("double").alias(f) for f in FEATURES]).coalesce(2), "labelled")
    points = [(k + 0.5) / BINS for k in range(BINS)]
    found = sample.agg(*[F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES]).first()
    values = {f: sorted(set(found[f] or [])) for f in FEATURES}
    bins = {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in values.items()}  # thresholds lie between quantiles
    # a row's bin is the number of edges that do not lie above its value
    edge_sum = {f: reduce(lambda a, b: a + b, [(F.col(f) >= F.lit(e)).cast("int") for e in edges], F.lit(0)) for f, edges in bins.items()}
    table = stored(sample.select("*", *[c.alias(f"bin_{f}") for f, c in edge_sum.items()]).coalesce(2), "binned")
    rules: list[list[Condition]] = []
    live = table
    while len(rules) < MAX_RULES:
        rule = _grow(live.where(~F.col("pruning")), bins)
        if not rule:
            break
        rule, p, n = _prune(live.where("pruning"), rule)
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule)
        live = live.where(~conjunction(rule))
    drop(sample)
    drop(table)
    return rules


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Judge every whole text by a decision list learned from the labelled ones.

    Returns ``keep`` (by default doc_id), the statistics, base_failed, rule
    (number of the rule that rejects the text, 0: none) and kept. Kept columns of
    these names, in any case, are replaced by the results. Labels are (doc_id, quality); repeated labels of a document count
    each time. Null and empty texts fail the base. Repeated rows are judged alike;
    an empty table gives no rows.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f for f in FEATURES if f != "n_words"], "base_failed", "rule", "kept"]
    columns, keep = docs.columns, without(keep or ["doc_id"], made)
    docs = carried(docs, "doc_id", "text").withColumn("tm_id", F.col("doc_id"))
    plain = ["doc_id", *(["text"] if any(place_of(columns, c) == place_of(columns, "text") for c in keep) else [])]
    rest = [REST] if any(place_of(columns, c) not in (place_of(columns, "doc_id"), place_of(columns, "text")) for c in keep) else []
    stats = stored(with_statistics(docs, ["tm_id", *plain, *rest]), "statistics")
    known = labels.select(F.col("doc_id").alias("tm_doc"), F.col("quality").alias("tm_quality"))
    own = stats.select("tm_id", *FEATURES, "n_repeat_words").where(~base_failed())
    labelled = own.join(known, F.col("tm_id") == F.col("tm_doc")).select(F.col("tm_id").alias("doc_id"), F.col("tm_quality").alias("quality"), *FEATURES)
    labelled = stored(labelled, "labelled")  # read to count, to choose and to learn
    rules = learn(labelled)
    drop(labelled)
    failed = base_failed()
    judged = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return judged.select(*[kept_column(columns, c, ["doc_id", "text"]) for c in keep], *made)
