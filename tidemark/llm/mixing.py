"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A Bernoulli naive Bayes classifier, fitted on labelled texts, gives every text a
posterior over domains. A text of n tokens and posterior p adds r * n * p[k]
expected tokens to domain k at a rate r. Projected gradient descent fits rates
between 0 and ``most`` that start at 1, so that the expected totals s match the
targets:

* wanted domains share their sum in the proportion of their weights;
* any other domain has at most its weight in the sum of all. One that has less is
  left as it is and costs no text of the others.

It minimises sum_k e[k]**2 / E[k], where e are the distances from these goals and
E the totals at rate 1. e[k] is linear in the rates: a text adds r * n * a[k], with
a[k] = p[k] less the goal's share of the p it is measured against. In the metric
weighted by n the gradient of a rate is sum_k a[k] e[k] / E[k]; a step scaled by
the Gram matrix of the rows that can move is tried first. The total is free, so no
text of a wanted domain is given up that the goals don't ask for. One step is one
aggregation with a sum for each domain and pair of domains; only these sums reach
the driver.

Sampling takes a text by a hash u < rate + d, where d, close to 0, makes the
tokens taken of the texts that lean to a domain what their rates say. It comes
from sums over bins of u - rate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import REST, carried, kept_column, place_of, without
from .skew import smallest_hashes
from .storage import drop, stored

BUCKETS = 1 << 20
#: Most buckets that the classifier uses: those with the clearest differences.
MAX_FEATURES = 1024
#: Most labelled rows to fit on; they are those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
#: A bucket speaks for a domain if its share there is larger than elsewhere by so many standard errors and by this factor.
#: Weaker differences, and words that a domain lacks, mostly follow length and language and would be counted for every word.
LEAST_Z, LEAST_RATIO = 4.0, 3.0
#: Most steps, distance from a goal as a share of it that ends them, and steps after which the rates are written.
STEPS, TOLERANCE, STORE_EVERY = 40, 5e-4, 20
#: Places of u - rate, and classes of the largest posterior, that sampling tells apart.
CUTS, LEVELS = 1 << 12, 16
TARGETS = {"good": 0.95, "low": 0.03, "toxic": 0.02}
#: Domains that set the total; where the targets name none of them, all domains do.
WANTED = ("good",)


def label_domains(labels: DataFrame) -> DataFrame:
    """Domain of every labelled document: toxic, low (quality 0) or good; null labels give none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, tm_tokens (words between white space), tm_u (a hash of the row in [0, 1)) and tm_features of whole texts.

    Features are word buckets and, after them, bins of three statistics: share
    of symbols, distinct words a word, and characters a word.
    """
    text = F.coalesce("text", F.lit(""))
    plain = F.regexp_replace(text, "[#*$%&|<>]+", "")
    words = F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")
    u = F.pmod(F.xxhash64(F.lit("take"), "doc_id", "text"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    one = docs.select(*keep, u.alias("tm_u"), words.alias("tm_w"), F.size(F.array_remove(F.split(text, "[ \\x09-\\x0D]+"), "")).cast("long").alias("tm_tokens"), F.length(text).alias("tm_n"), (F.length(text) - F.length(plain)).alias("tm_s"))
    two = one.select(*keep, "tm_u", "tm_tokens", "tm_n", "tm_s", F.size("tm_w").alias("tm_words"), F.array_distinct(F.transform("tm_w", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))).alias("tm_b"))

    def bin_of(x: Column, y: Column, step: float, place: int) -> Column:
        return (F.lit(BUCKETS + 32 * place) + F.least(F.lit(31), F.floor(F.coalesce(F.try_divide(x, y), F.lit(0.0)) / step)).cast("int")).cast("int")

    extra = F.array(bin_of(F.col("tm_s"), F.col("tm_n"), 0.01, 0), bin_of(F.size("tm_b"), F.col("tm_words"), 0.04, 1), bin_of(F.col("tm_n"), F.col("tm_tokens"), 0.5, 2))
    return two.select(*keep, "tm_u", "tm_tokens", F.concat("tm_b", extra).alias("tm_features"))


@dataclass
class Classifier:
    """Log weights: ``start`` of each domain, and for each of the few ``features`` one weight for each domain; ``known``: domains with labelled rows."""

    start: list[float]
    features: list[int]
    weights: list[list[float]]
    known: list[int]


def fit(features: DataFrame, domains: list[str], rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on (doc_id, tm_u, tm_features, domain).

    At most ``rows`` distinct rows are used: those with the smallest hashes of
    doc_id. A domain without rows keeps a small prior.
    """
    distinct = stored(features.where(F.col("domain").isin(domains)).dropDuplicates(["doc_id", "tm_u", "domain"]), "labelled")
    sample = smallest_hashes(distinct, rows, "doc_id", ["doc_id", "tm_u", "domain"]).select("domain", F.col("tm_features").alias("features"))
    sample = stored(sample, "labelled")
    drop(distinct)
    n = {d: 0 for d in domains} | {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    total = sum(n.values())
    start = [math.log((n[d] + 1) / (total + len(domains))) for d in domains]
    each = sample.select("domain", F.explode("features").alias("f")).groupBy("f").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)])
    every = sum((F.col(f"n{k}") for k in range(1, len(domains))), F.col("n0"))
    scores = []
    for k, d in enumerate(domains):
        if not n[d] or n[d] == total:
            continue
        p, q = (F.col(f"n{k}") + 0.5) / (n[d] + 1), (every - F.col(f"n{k}") + 0.5) / (total - n[d] + 1)
        share = every / total
        error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n[d] + 1 / (total - n[d])))
        z = (p - q) / error
        scores.append(F.when((z >= LEAST_Z) & (p >= LEAST_RATIO * q), F.struct(z.alias("z"), F.lit(k).alias("k"), p.alias("p"), q.alias("q"))))
    found = []
    if scores:
        hits = each.select("f", F.explode(F.filter(F.array(*scores), lambda x: x.isNotNull())).alias("s"))
        found = hits.orderBy(F.desc("s.z"), "f").limit(MAX_FEATURES).collect()
    drop(sample)
    places = sorted({r["f"] for r in found})
    weights = {f: [0.0] * len(domains) for f in places}
    for r in found:
        k, p, q = r["s"]["k"], r["s"]["p"], r["s"]["q"]
        weights[r["f"]][k] = math.log(p / q) - math.log((1 - p) / (1 - q))
        start[k] += math.log((1 - p) / (1 - q))
    return Classifier(start, places, [weights[f] for f in places], [k for k, d in enumerate(domains) if n[d]])


def _numbers(values: list, kind: str) -> Column:
    """A constant array, folded from text so that it costs one literal."""
    return F.split(F.lit(",".join(f"{x:.12g}" if kind == "double" else str(x) for x in values)), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _weighted_sum(places: str, start: float, known: Column, table: Column) -> Column:
    return F.aggregate(places, F.lit(float(start)), lambda a, f: a + F.get(table, F.array_position(known, f).cast("int") - 1))


def posteriors(features: DataFrame, model: Classifier) -> DataFrame:
    """Replace ``tm_features`` by ``tm_p`` (array of doubles that sum to 1, by domain)."""
    known = _numbers(model.features, "int")
    rest = [c for c in features.columns if c != "tm_features"]
    own = features.select(*rest, F.array_intersect("tm_features", known).alias("tm_f"))
    sums = [_weighted_sum("tm_f", b, known, _numbers([w[k] for w in model.weights], "double")) for k, b in enumerate(model.start)]
    scored = own.select(*rest, F.array(*sums).alias("tm_log"))
    raised = scored.select(*rest, F.transform("tm_log", lambda x: F.exp(F.greatest(x - F.array_max("tm_log"), F.lit(-700.0)))).alias("tm_e"))
    return raised.select(*rest, F.transform("tm_e", lambda x: x / F.aggregate("tm_e", F.lit(0.0), lambda a, y: a + y)).alias("tm_p"))


def fit_rates(members: DataFrame, shares: list[float], wanted: list[int] | None = None, known: list[int] | None = None, most: float = 1.0) -> DataFrame:
    """Add ``tm_rate`` to a table with tm_tokens and tm_p so that expected domain totals meet the shares.

    ``wanted`` and ``known`` are numbers of domains, by default all. Domains that
    aren't known have no goal; without a known wanted domain all rates are 1.
    Rates lie between 0 and ``most``; where the goals can't be met they minimise
    the objective. An empty table gives no rows.
    """
    k = len(shares)
    known = list(range(k)) if known is None else known
    leading = [j for j in known if shares[j] > 0 and (wanted is None or j in wanted)]
    rest = [c for c in members.columns if c != "tm_rate"]
    state = members.select(*rest, F.lit(1.0).alias("tm_rate"))
    if not leading:
        return state
    others = [j for j in known if j not in leading]
    # e = goals @ s: each domain's total less its goal's share of the totals it is measured against
    goals = np.zeros((k, k))
    for group, base, over in ((leading, leading, sum(shares[j] for j in leading)), (others, known, 1.0)):
        for j in group:
            goals[j, base] = -shares[j] / over
            goals[j, j] += 1
    scale_of = lambda have: np.where(have > 0, have, 1.0)
    p = [F.get("tm_p", j) for j in range(k)]
    a = [sum((F.lit(float(goals[j, i])) * p[i] for i in range(1, k)), F.lit(float(goals[j, 0])) * p[0]) for j in range(k)]

    def along(slope: np.ndarray) -> Column:
        """How much a step lowers a row's rate."""
        return sum((F.lit(float(x)) * a[j] for j, x in enumerate(slope) if x), F.lit(0.0))

    def sums(rate: Column, slope: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Domain totals at a rate, and the Gram matrix of the rows that the last step could have moved further."""
        tokens = F.col("tm_tokens").cast("double")
        live = F.lit(True) if slope is None else F.when(F.col("tm_s") > 0, F.col("tm_r") > 0).otherwise(F.col("tm_r") < most)
        weight = F.when(live, tokens).otherwise(0.0)
        cells = [F.sum(F.col("tm_r") * tokens * p[j]).alias(f"s{j}") for j in range(k)]
        cells += [F.sum(weight * a[i] * a[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]
        row = state.select("tm_tokens", "tm_p", rate.alias("tm_r"), (F.lit(0.0) if slope is None else along(slope)).alias("tm_s")).agg(*cells).first()
        gram = np.array([[row[f"g{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        return np.array([row[f"s{j}"] or 0.0 for j in range(k)]), gram

    def excess(s: np.ndarray) -> np.ndarray:
        """Distances from the goals; 0 where a bound is kept or there is no goal."""
        e = goals @ s
        e[others] = np.maximum(e[others], 0.0)
        return e

    rate, since = F.col("tm_rate"), 0
    now, gram = sums(rate, None)
    scale = scale_of(now)
    error = lambda s: float((excess(s) ** 2 / scale).sum())
    for _ in range(STEPS):
        over = excess(now)
        goal = np.array(shares) * now[known].sum()
        if (np.abs(over) <= TOLERANCE * goal).all():
            break
        own, scaled = np.flatnonzero(over), np.zeros(k)
        scaled[own] = np.linalg.lstsq((gram + 1e-9 * np.diag(scale))[np.ix_(own, own)], over[own], rcond=None)[0]
        safe = over / scale
        for slope in (scaled, scaled / 2, safe, safe / 4):
            tried = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), rate - along(slope)))
            then, then_gram = sums(tried, slope)
            if error(then) < error(now):
                break
        else:
            break  # no step lowers the error: the goals can't be met better
        rate, now, gram, since = tried, then, then_gram, since + 1
        if since == STORE_EVERY:
            state, rate, since = stored(state.select(*rest, rate.alias("tm_rate")), "rates"), F.col("tm_rate"), 0
    return state.select(*rest, rate.alias("tm_rate"))


def with_copies(rated: DataFrame, domains: int) -> DataFrame:
    """Add ``tm_copies``: how often sampling takes each row of a table with tm_p, tm_tokens, tm_u and tm_rate.

    Rows are told apart by the domain they lean to and by how much they do; what
    one such class takes too much or too little, the next one of its domain makes up for.
    """
    most = F.array_max("tm_p")
    kind = ((F.array_position("tm_p", most) - 1) * LEVELS + F.least(F.floor(most * LEVELS), F.lit(LEVELS - 1))).cast("int")
    part = F.col("tm_rate") - F.floor("tm_rate")
    place = F.col("tm_u") - part
    cells = rated.where((part > 0) & (F.col("tm_tokens") > 0)).groupBy(kind.alias("k"), F.floor((place + 1) * (CUTS // 2)).alias("b"))
    found = cells.agg(F.sum("tm_tokens").alias("n"), F.sum(part * F.col("tm_tokens")).alias("want")).collect()  # a row for each class and place at most
    cuts, missing = [], 0.0
    for k in range(domains * LEVELS):
        own = sorted((r["b"], r["n"], r["want"]) for r in found if r["k"] == k)
        missing = (0.0 if k % LEVELS == 0 else missing) + sum(w for _, _, w in own)
        taken = np.append(0, np.cumsum([n for _, n, _ in own]))
        at = int(np.argmin(np.abs(taken - missing)))
        missing -= float(taken[at])
        # all places below the cut are taken
        cuts.append(own[at][0] / (CUTS // 2) - 1 if at < len(own) else 1.0)
    cut = F.get(_numbers(cuts, "double"), kind)
    return rated.withColumn("tm_copies", (F.floor("tm_rate") + ((part > 0) & (place < cut)).cast("int")).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: list[str] | None = None, most: float = 1.0) -> DataFrame:
    """Rates for all documents from labelled ones.

    ``labels`` holds (doc_id, domain), ``targets`` the weight of each domain, and
    ``most`` is the largest rate; over 1, texts may be taken more than once.
    Returns ``keep`` (by default doc_id), n_tokens, one double ``p_<domain>`` for
    each domain by name, rate, copies (how often sampling takes the row) and taken
    (copies > 0). Kept columns of these names, in any case, are replaced by the
    results. A null text has no token and the prior's
    posterior. Repeated rows get equal results. Labels of unknown documents and of
    other domains are ignored; of equal (doc_id, text, domain) one counts. Domains
    without labels aren't rated: if no wanted domain (``WANTED``) has any, all
    rates are 1. An empty table gives no rows.
    """
    targets = targets or TARGETS
    domains = sorted(targets)
    made = ["n_tokens", *[f"p_{d}" for d in domains], "rate", "copies", "taken"]
    columns, keep = docs.columns, without(keep or ["doc_id"], made)
    docs, places = carried(docs, "doc_id", "text"), {place_of(columns, c) for c in keep}
    own = ["doc_id", *(["text"] if place_of(columns, "text") in places else []), *([REST] if places - {place_of(columns, c) for c in ("doc_id", "text")} else [])]
    weight = sum(targets.values())
    # a bounded number of labels of documents that are here, so their texts need no shuffle
    here = labels.where(F.col("domain").isin(domains)).select("doc_id", "domain").join(docs.select("doc_id"), "doc_id", "left_semi")
    known = smallest_hashes(stored(here, "here"), TRAIN_ROWS, "doc_id", ["doc_id", "domain"])
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    model = fit(with_features(labelled, ["doc_id", "domain"]), domains)
    members = stored(posteriors(with_features(docs, own), model), "members")
    wanted = [j for j, d in enumerate(domains) if d in WANTED] or None
    rated = with_copies(fit_rates(members, [targets[d] / weight for d in domains], wanted, model.known, most), len(domains))
    return rated.select(*[kept_column(columns, c, ["doc_id", "text"]) for c in keep], F.col("tm_tokens").alias("n_tokens"), *[F.get("tm_p", j).alias(f"p_{d}") for j, d in enumerate(domains)], F.col("tm_rate").alias("rate"), F.col("tm_copies").alias("copies"), (F.col("tm_copies") > 0).alias("taken"))
