"""Mixing against an independent classifier, its goals, and the sampling of the rates."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import mixing

SF = "/root/testdata/sf0.1"


def corpus(kinds, seed=9, labelled=lambda k: k % 2):
    """(rows, labels): texts of random words; low and toxic ones hold words of their own."""
    r = random.Random(seed)
    rows, labels = [], []
    for k, kind in enumerate(kinds):
        w = [f"w{r.randrange(50)}" for _ in range(r.randrange(20, 60))] + {"good": [], "low": ["junk"] * 4, "toxic": ["vile", "nasty"]}[kind]
        r.shuffle(w)
        rows.append((k, " ".join(w), kind, k))
        if labelled(k):
            labels.append((k, kind))
    return rows, labels


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(1)
    rows, labels = corpus([r.choices(["good", "low", "toxic"], [0.7, 0.2, 0.1])[0] for _ in range(600)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, n_tokens long").withColumns({"posterior": F.lit(1), "rate": F.lit("x"), "features": F.lit(2), "u": F.lit(3)})
    return docs, spark.createDataFrame(labels, "doc_id long, domain string")


def features_by_force(text):
    low = re.sub(r"[^\w]+|_+", " ", (text or "").lower()).split()
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    own = {signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) % mixing.BUCKETS for w in low}
    n, tokens = len(text or ""), len((text or "").split())
    share = lambda a, b, step: min(31, math.floor(a / b / step)) if b else 0
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return own | {mixing.BUCKETS + share(symbols, n, 0.01), mixing.BUCKETS + 32 + share(len(own), len(low), 0.04), mixing.BUCKETS + 64 + share(n, tokens, 0.5)}


def posteriors_by_force(rows, labels, domains):
    """Naive Bayes over the features that speak for a domain, for all rows."""
    text = {d: t for d, t in rows}
    train = [(features_by_force(text[d]), k) for d, k in labels]
    n = {d: sum(k == d for _, k in train) for d in domains}
    total = len(train)
    start = {d: math.log((n[d] + 1) / (total + len(domains))) for d in domains}
    weights = []
    for f in set().union(*(x for x, _ in train)):
        held = {d: sum(f in x for x, k in train if k == d) for d in domains}
        every = sum(held.values())
        for d in domains:
            if not n[d] or n[d] == total:
                continue
            p, q = (held[d] + 0.5) / (n[d] + 1), (every - held[d] + 0.5) / (total - n[d] + 1)
            share = every / total
            z = (p - q) / math.sqrt(max(share * (1 - share), 1e-9) * (1 / n[d] + 1 / (total - n[d])))
            if z >= mixing.LEAST_Z and p >= mixing.LEAST_RATIO * q:
                weights.append((f, d, math.log(p / q), math.log((1 - p) / (1 - q))))
    out = {}
    for d, t in rows:
        own = features_by_force(t)
        logs = np.array([start[k] + sum(yes if f in own else no for f, e, yes, no in weights if e == k) for k in domains])
        e = np.exp(logs - logs.max())
        out[d] = e / e.sum()
    return out


def test_posteriors_rates_and_sampling_equal_brute_force(mixed):
    docs, labels = mixed
    domains = sorted(mixing.TARGETS)
    want = posteriors_by_force([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["domain"]) for r in labels.collect()], domains)
    out = mixing.mix(docs, labels, keep=docs.columns).collect()
    assert len(out) == 600
    tokens = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    for r in out:
        assert r["n_tokens"] == tokens[r["doc_id"]] and r["posterior"] == 1
        assert [r[f"p_{d}"] for d in domains] == pytest.approx(want[r["doc_id"]].tolist(), abs=1e-6)
    # the goals hold for totals of the independent posteriors, at rates between 0 and 1
    rates = {r["doc_id"]: r["rate"] for r in out}
    totals = sum(rates[d] * tokens[d] * want[d] for d in rates)
    for d, x in zip(domains, totals / totals.sum(), strict=True):
        assert x == pytest.approx(mixing.TARGETS[d], rel=2e-3)
    assert all(0 <= x <= 1 for x in rates.values())
    # what is taken of the texts that lean to a domain is what their rates say, up to one text
    for k, d in enumerate(domains):
        own = [r for r in out if np.argmax(want[r["doc_id"]]) == k]
        assert abs(sum(r["n_tokens"] * r["copies"] for r in own) - sum(r["n_tokens"] * r["rate"] for r in own)) <= max(r["n_tokens"] for r in own)
    assert all(r["copies"] in (0, 1) and r["taken"] == (r["copies"] > 0) for r in out)


def test_rates_over_one_give_copies(spark):
    rows, labels = corpus(["good"] * 100 + ["low"] * 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, n long")
    out = mixing.mix(docs, spark.createDataFrame(labels, "doc_id long, domain string"), {"good": 0.75, "low": 0.25}, most=3.0).collect()
    assert max(r["rate"] for r in out) > 1 and max(r["copies"] for r in out) == 2
    total = {d: sum(r["copies"] * r["n_tokens"] * r[f"p_{d}"] for r in out) for d in ("good", "low")}
    assert total["good"] / sum(total.values()) == pytest.approx(0.75, rel=0.02)


def test_several_wanted_domains_share_by_weight(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WANTED", ("good", "low"))
    rows, labels = corpus(["good"] * 200 + ["low"] * 50)
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, kind string, n long"), spark.createDataFrame(labels, "doc_id long, domain string"), {"good": 0.5, "low": 0.5}).collect()
    total = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in out) for d in ("good", "low")}
    assert total["good"] == pytest.approx(total["low"], rel=2e-3)
    assert all(r["rate"] > 0.95 for r in out if r["p_low"] > 0.99)  # the scarcer one sets the total


def test_weights_are_met_on_the_test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix(docs, mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet")))
    sums = {}
    for by in ("rate", "copies"):
        row = out.agg(*[F.sum(F.col(by) * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in mixing.TARGETS]).first()
        sums[by] = {d: row[d] / sum(row) for d in mixing.TARGETS}
    for d, w in mixing.TARGETS.items():
        assert sums["rate"][d] == pytest.approx(w, rel=2e-3)
        assert sums["copies"][d] == pytest.approx(w, rel=0.02)


@pytest.mark.parametrize("toxic,labelled", [(0.0, True), (0.005, True), (0.005, False), (0.1, False), (0.1, None)])
def test_scarce_or_unlabelled_domains_cost_no_clean_documents(spark, toxic, labelled):
    kinds = ["toxic" if k < 1000 * toxic else "low" if k % 5 == 0 else "good" for k in range(1000)]
    rows, labels = corpus(kinds, 3, lambda k: labelled is not None and (k % 2 or kinds[k] == "toxic") and (labelled or kinds[k] != "toxic"))
    table = spark.createDataFrame(rows, "doc_id long, text string, kind string, n long")
    out = mixing.mix(table, spark.createDataFrame(labels, "doc_id long, domain string"), keep=["doc_id", "kind"]).collect()
    good = [x for x in out if x["kind"] == "good"]
    assert len(out) == 1000 and sum(x["taken"] for x in good) >= 0.99 * len(good)
    assert labelled is not None or all(x["rate"] == 1 for x in out)
    # a domain with more than its share is still sampled down
    assert labelled is None or sum(x["taken"] for x in out if x["kind"] == "low") < 0.5 * sum(x["kind"] == "low" for x in out)


def test_nulls_repeats_long_texts_and_empty_tables(spark, mixed):
    docs, labels = mixed
    odd = [(None, "junk vile w1"), (7001, None), (7002, ""), (7003, "w1 " * 400_000), (7004, "w2 junk"), (7004, "w2 junk"), (None, None)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    more = labels.unionByName(spark.createDataFrame([(None, "low"), (7004, None), (7001, "low"), (9999, "good"), (5, "unknown")], labels.schema))
    got = mixing.mix(table, more).where("doc_id is null or doc_id > 7000").collect()
    assert len(got) == 7 and sorted(r["n_tokens"] for r in got) == [0, 0, 0, 2, 2, 3, 400_000]
    twice = [tuple(r) for r in got if r["doc_id"] == 7004]
    assert twice[0] == twice[1]
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.TARGETS) - 1) < 1e-9 for r in got)
    assert mixing.mix(table.where("false"), labels).count() == 0
    assert {r["rate"] for r in mixing.mix(docs, labels.where("false")).collect()} == {1.0}
