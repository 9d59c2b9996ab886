"""License scans: exact set-similarity join of text blocks with license templates.

Blocks are windows of words, whatever the line breaks, so wrapped notices and
notices in long lines are found alike. A window is as long as a template that has
``percent`` of its words. A template is found in a block when the block holds at
least ``percent`` of the template's distinct words. Words of the templates are
ordered by the number of texts of the corpus that hold them, rare ones first. A
block that holds enough of a template holds one of its first ``size - need + 1``
words (prefix filter), so only windows around such a word are looked at, and only
if the words on either side of it hold enough of the template (length filter). A
window starts at a word of the template and reaches the prefix word (positional
filter). What passes is verified by the exact intersection. All steps are DataFrame
operations; only the template words are held by every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by license (fixed values: wording of public license notices).
TEMPLATES = {
    "agpl-3": ["licensed under the gnu affero general public license version 3"],
    "all-rights-reserved": ["all rights reserved"],
    "apache-2": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl-3": ["this work is licensed under the gnu general public license version 3"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
#: Phrases whose words, one after another, give a base label (fixed values).
PHRASES = {"apache license version 2": "apache-2", "cc by nc": "cc-by-nc", "under the mit license": "mit"}
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PERCENT = 80


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; other letters stay."""
    t = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, upper, upper.lower()))
    return F.array_remove(F.split(low, _BETWEEN), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_order(docs: DataFrame, templates: dict[str, list[str]]) -> list[str]:
    """Words of the templates by the number of texts that hold them, rare ones first, then by name."""
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in t.split()})
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), _strings(vocabulary))).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in held.collect()}  # a row for each template word at most
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def similar_windows(docs: DataFrame, key: list[str], templates: dict[str, list[str]] | None = None, percent: int = PERCENT, order: list[str] | None = None) -> DataFrame:
    """Places of all templates at the containment threshold, whatever the line breaks.

    A place is the best window around a word of a template's prefix: the one with
    most of its words, of those the shortest. Windows have at most 100 / ``percent``
    times the template's number of words. Returns the key columns, license,
    template, first and last (word numbers in the text, from 0), containment and
    words (array of the template's words at the place, each after its word number).
    Null and empty texts have no place. Repeated rows give their places once for each key.
    """
    templates = TEMPLATES if templates is None else templates
    order = word_order(docs, templates) if order is None else order
    rank = {w: k for k, w in enumerate(order)}
    rows, widest = [], 1
    for name, texts in sorted(templates.items()):
        for number, text in enumerate(texts):
            words = sorted(set(text.split()), key=rank.__getitem__)
            need = -(-len(words) * percent // 100)
            span = -(-len(text.split()) * 100 // percent)
            widest = max(widest, span)
            rows += [(w, name, number, span, need, words) for w in words[: len(words) - need + 1]]
    index = docs.sparkSession.createDataFrame(rows, "prefix string, license string, template int, span int, need int, t_words array<string>")
    prefixes = sorted({r[0] for r in rows})
    own = docs.where(F.arrays_overlap(words_of(F.col("text")), _strings(prefixes)))
    own = own.select(*key, words_of(F.col("text")).alias("all"))
    at = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.get("all", i).isin(prefixes))
    start = lambda i: F.greatest(F.lit(0), i - (widest - 1))
    near = F.transform(at, lambda i: F.struct(i.alias("at"), start(i).alias("start"), F.slice("all", start(i) + 1, i - start(i) + widest).alias("part")))
    near = own.select(*key, F.explode(near).alias("n")).select(*key, "n.at", "n.start", "n.part", F.get("n.part", F.col("n.at") - F.col("n.start")).alias("prefix"))
    pairs = near.join(F.broadcast(index), "prefix")
    pairs = pairs.where(F.size(F.array_intersect("part", "t_words")) >= F.col("need"))
    # windows that hold the prefix word and start with a word of the template
    low, high = F.greatest(F.lit(0), F.col("at") - F.col("start") - F.col("span") + 1), F.col("at") - F.col("start")
    starts = F.filter(F.sequence(low, high), lambda i: F.array_contains("t_words", F.get("part", i)))
    windows = F.transform(starts, lambda i: F.struct(i.alias("i"), F.slice("part", i + 1, F.col("span")).alias("ws")))
    windows = F.transform(windows, lambda x: F.struct(x["i"].alias("i"), x["ws"].alias("ws"), F.array_intersect(x["ws"], F.col("t_words")).alias("hits")))
    # shorter first: less the place of the last of the distinct words
    ranked = F.transform(windows, lambda x: F.struct(F.size(x["hits"]).alias("n"), (-F.array_position(x["ws"], F.element_at(x["hits"], -1))).cast("int").alias("short"), (-x["i"]).alias("early")))
    best = pairs.select(*key, "license", "template", "start", "part", "need", "t_words", F.array_max(ranked).alias("b")).where(F.col("b.n") >= F.col("need"))
    first = -F.col("b.early")
    last = first - F.col("b.short") - 1
    words = F.transform(F.slice("part", first + 1, last - first + 1), lambda w, k: F.struct((F.col("start") + first + k).alias("at"), w.alias("w")))
    words = F.transform(F.filter(words, lambda x: F.array_contains("t_words", x["w"])), lambda x: F.concat_ws(" ", x["at"], x["w"]))
    found = best.select(*key, "license", "template", (F.col("start") + first).alias("first"), (F.col("start") + last).alias("last"), (F.col("b.n") / F.size("t_words")).alias("containment"), words.alias("words"))
    # one place for all prefix words around it
    return found.groupBy(*key, "license", "template", "first", "last").agg(F.max("containment").alias("containment"), F.first("words").alias("words"))


def found_licenses(docs: DataFrame, key: list[str], templates: dict[str, list[str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """Licenses of all windows: the key columns, more (array of licenses) and best (largest containment).

    Notices of related licenses share most of their words, so a template is left
    out where another license's holds more and has all of its words at that very
    place. Others stay.
    """
    templates = TEMPLATES if templates is None else templates
    places = similar_windows(docs, key, templates, percent, word_order(docs, templates))
    reach = max((-(-len(t.split()) * 100 // percent) for texts in templates.values() for t in texts), default=1)
    # a place meets all that overlap it in the group of its first word, as it reaches into two groups at most
    own_group, end_group = F.floor(F.col("first") / reach), F.floor(F.col("last") / reach)
    spots = places.select(*key, "license", F.col("containment").alias("c"), "words", own_group.alias("own_group"), F.explode(F.array_distinct(F.array(own_group, end_group))).alias("group"))
    each = spots.groupBy(*key, "group").agg(F.collect_set(F.struct((F.col("group") == F.col("own_group")).alias("judged"), "license", "c", "words")).alias("m"))
    covers = lambda b, m: (b["license"] != m["license"]) & (b["c"] > m["c"]) & (F.size(F.array_except(m["words"], b["words"])) == 0)
    own = F.filter("m", lambda m: m["judged"] & ~F.exists("m", lambda b: covers(b, m)))
    found = each.select(*key, F.transform(own, lambda m: m["license"]).alias("own"), F.array_max(F.transform("m", lambda m: m["c"])).alias("c"))
    return found.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("more"), F.max("c").alias("best"))


def _places(words: Column, phrase: list[str], label: str) -> Column:
    def holds(k: Column) -> Column:
        test = F.get(words, k).eqNullSafe(F.lit(phrase[0]))
        for j, w in enumerate(phrase[1:], 1):
            test = test & F.get(words, k + j).eqNullSafe(F.lit(w))
        return test

    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), holds)
    return F.transform(at, lambda k: F.struct(F.lit(label).alias("label"), k.alias("at")))


def phrase_places(words: Column) -> Column:
    """Places of all base phrases as structs (label, at), by phrase."""
    parts = [_places(words, phrase.split(), label) for phrase, label in sorted(PHRASES.items())]
    # every phrase holds one of these words
    return F.when(F.arrays_overlap(words, _strings(["license", "nc"])), F.concat(*parts))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """Licenses of every whole text.

    Returns doc_id, n_words, n_base (places of base phrases), first_word,
    last_word (their smallest and largest start; else null), base_labels, labels
    (base ones and those of ``found_licenses``; distinct, sorted, comma-joined) and
    score (largest containment, 1 with a base label, else 0). A null text counts
    as empty. Rows with equal doc_id and text get equal results; an empty table
    gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tm_hash", F.xxhash64(text))
    found = found_licenses(keyed, ["doc_id", "tm_hash"], templates, percent)
    found = found.withColumnsRenamed({"doc_id": "tm_id", "tm_hash": "tm_own"})
    base = keyed.select("doc_id", "tm_hash", words_of(F.col("text")).alias("w"))
    base = base.select("doc_id", "tm_hash", F.size("w").cast("long").alias("n_words"), phrase_places(F.col("w")).alias("p"))
    base = base.select("doc_id", "tm_hash", "n_words", F.coalesce(F.size("p"), F.lit(0)).alias("size"), F.transform("p", lambda x: x["at"]).alias("at"), F.coalesce(F.array_sort(F.array_distinct(F.transform("p", lambda x: x["label"]))), F.array().cast("array<string>")).alias("own"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("tm_id")) & (F.col("tm_hash") == F.col("tm_own")), "left")
    none = F.array().cast("array<string>")
    some = F.size("own") > 0
    return joined.select(
        "doc_id",
        "n_words",
        F.when(some, F.col("size")).otherwise(0).cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.coalesce("more", none))), ",").alias("labels"),
        F.when(some, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
