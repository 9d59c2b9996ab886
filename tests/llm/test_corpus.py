"""Corpus operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import random
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import SF, SPACE, VOCABULARY, groups_by_force, library, words
from tidemark.llm import decision_list, isomedia, langid, license_join, line_dedup, near_dup, packing, queries, rans, subword, token_counts
from tidemark.llm.components import connected_components


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    base = words(120, 1)
    out = [None, "", " \n\t", "one", "The end.", "The end.", "a b c", "don't we'll I'd 've 'S''s", "x<|endoftext|>y", "naïve Ɏ 中文 é  ½ 12", "tab\tand  two   spaces \n\n end "]
    for k in range(12):
        w = list(base)
        for _ in range(k):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    out += [" ".join(words(3000, 5)), "\n".join(" ".join(words(8, k % 4)) for k in range(12)), "A B C D", "a b\nc d"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Ids with gaps and a null one; every text once, one row repeated; a column that clashes with results."""
    rows = [(3 * k, t, "x", len(t or "")) for k, t in enumerate(texts)] + [(None, "lost row", "x", 8), (3 * 4, texts[4], "x", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_chars long").repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_ids_equal_the_library(texts):
    r = random.Random(3)
    odd = ["".join(r.choice("ab'stredvlm  \n\t!?12é߀中 ½xɎՠ") for _ in range(r.randrange(40))) for _ in range(3000)]
    odd += [f"a{chr(c)}1{chr(c)}!{chr(c)}  {chr(c)}" for c in range(0, 0x30000, 37) if not 0xD800 <= c < 0xE000]
    column = [t or "" for t in texts] + odd
    ids, bounds = subword.piece_table(VOCABULARY).encode(subword.text_column(pa.array(column)))
    for k, want in enumerate(library().encode_batch(column, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want.ids, column[k]


def test_forgetting_changes_nothing(monkeypatch, texts):
    monkeypatch.setattr(subword, "CACHE_ENTRIES", 10)
    table = subword.PieceTable(VOCABULARY)
    for t in texts:
        ids, _ = table.encode(subword.text_column(pa.array([t])))
        assert ids.tolist() == library().encode(t or "", add_special_tokens=False).ids


def test_equal_hashes_change_nothing(monkeypatch, texts):
    monkeypatch.setattr(subword, "piece_hashes", lambda raw, ends: np.diff(ends).astype(np.uint64) % np.uint64(3))
    table = subword.PieceTable(VOCABULARY)
    for t in texts + texts:
        ids, _ = table.encode(subword.text_column(pa.array([t])))
        assert ids.tolist() == library().encode(t or "", add_special_tokens=False).ids


def test_many_pieces_are_encoded_once(monkeypatch):
    table, words = subword.PieceTable(VOCABULARY), np.array(list("abcdefghij"))
    steps = [[" " + "".join(words[[int(c) for c in str(k)]]) for k in range(a, a + 100_000)] for a in range(100_000, 500_000, 100_000)]
    first = [table.count_pieces([w.encode() for w in step]) for step in steps]
    monkeypatch.setattr(table, "learn", lambda *_: pytest.fail("encoded again"))
    for step, counts in zip(steps, first, strict=True):
        assert table.count_pieces([w.encode() for w in step]).tolist() == counts.tolist()
    held = sum(x.nbytes for x in (table.ids, table.ends, table.text, table.text_ends, table.hashes, table.row_of))
    assert held < 150 * 400_000
    assert first[0][:50].tolist() == [len(library().encode(w, add_special_tokens=False).ids) for w in steps[0][:50]]


def expected_documents(rows):
    """Per document its ids with the end id, in ascending id order (null first)."""
    tk = library()
    coded = sorted(((-1 if r["doc_id"] is None else r["doc_id"], tk.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in rows), key=lambda x: x[0])
    return coded


def test_range_coder_round_trip(docs):
    got = sorted((tuple(r) for r in rans.encode_decode(docs, VOCABULARY, 50_257).collect()), key=lambda r: r[1])
    start, want = 0, []
    for doc_id, ids in expected_documents(docs.collect()):
        want.append((None if doc_id < 0 else doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_range_coder_of_nothing(empty):
    assert rans.encode_decode(empty, VOCABULARY, 50_257).count() == 0


@pytest.mark.parametrize("size", [1, 31, 32, 33, 8192, 8193, 20_000])
def test_segments_decode_alone(size):
    r = np.random.default_rng(size)
    ids = np.minimum(r.geometric(0.02, size), 999).astype(np.uint32)
    coder = rans.Coder(rans.frequency_table(np.bincount(ids, minlength=1000), 12), 12)
    blob = rans.pack_block([5], [size], ids, coder.encode([ids])[0])
    _, _, lanes, parts, sums, stream = rans.unpack_block(blob)
    for k, part in enumerate(parts):
        (own,) = coder.decode([part], stream, lanes)
        assert (own == ids[k * lanes * rans.CHECKPOINT_STEPS :][: len(own)]).all() and zlib.crc32(own.astype("<u4").tobytes()) == sums[k]
    with pytest.raises(ValueError):
        rans.unpack_block(blob[:-1] + bytes([blob[-1] ^ 1]))


def test_frequencies_fill_the_table():
    f = rans.frequency_table(np.array([0, 1, 10**9, 3]), 4)
    assert f.sum() == 16 and f[0] == 0 and f[1] >= 1 and f[3] >= 1
    with pytest.raises(ValueError):
        rans.frequency_table(np.ones(17), 4)


def test_packing_places_every_piece(docs):
    rows = [r.asDict() for r in packing.pack(docs, VOCABULARY, capacity=100, open_bins=3, with_ids=True).collect()]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 100
    want = Counter()
    for doc_id, ids in expected_documents(docs.collect()):
        start = 0
        for piece, size in enumerate(packing.piece_sizes(len(ids), 100)):
            want[None if doc_id < 0 else doc_id, piece, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())] += 1
            start += size
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert [p.place(s) for s in (6, 7, 3, 4, 9, 8)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    assert [p.place(s) for s in (5, 2, 1)] == [(4, 0), (3, 8), (4, 5)]
    assert packing.piece_sizes(25, 10) == [5, 10, 10] and packing.piece_sizes(20, 10) == [10, 10] and packing.piece_sizes(1, 10) == [1]


def test_token_counts(docs, empty, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT_ENTRIES", 5)  # the rest takes the join
    tk = library()
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(tk.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = token_counts.count_tokens(docs, VOCABULARY).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.count_tokens(empty, VOCABULARY).count() == 0


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(docs, width):
    got = near_dup.near_duplicates(docs, width=width).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == groups_by_force(docs.collect(), width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_a_large_group(spark):
    """Copies that differ from one another by more than they do from their source, and chains between them."""
    r, base, rows = random.Random(11), words(150, 2, 5000), []
    for k in range(160):
        w = list(base if k % 3 else rows[-1][1].split() if rows else base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dup.near_duplicates(table, width=4).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == groups_by_force(table.collect(), 4)


def test_near_duplicates_of_nothing(empty):
    assert near_dup.near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and got[101] == 100


def test_line_windows(spark, empty):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "r\nr\nr\nr\nr"), (7, "b\nc\nd\nz"), (None, "b\nc\nd"), (2, "x\na\nb\nc\ny")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.length("text").cast("long"), "lines_removed": F.lit("clash")})
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["lines_removed"]) for r in line_dedup.dedup_lines(table).collect()}
    assert got == {None: ("b\nc\nd", 5, 0), 1: ("a", 1, 3), 2: ("x\ny", 3, 3), 3: ("a\nb", 3, 0), 4: (None, None, 0), 5: ("", 0, 0), 6: ("r", 1, 4), 7: ("z", 1, 3)}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_media_round_trip(docs, empty):
    import hashlib

    for r in isomedia.text_media_digests(docs).collect():
        text = next((d["text"] or "").encode() for d in docs.collect() if d["doc_id"] == r["doc_id"])
        payload = text + b"\xff" * (-len(text) % 576 if text else 576)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(text), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        media = isomedia.mux(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert isomedia.text_media_digests(empty).count() == 0


def test_media_tables_and_damage(spark):
    file = isomedia.mux(bytes(576 * 30))
    (track,) = isomedia.parse(file)
    assert (track["codec"], track["samples"], track["duration"], track["keys"].tolist()) == ("raw ", 30, 30, [0, 12, 24])
    assert (np.diff(track["offsets"]) == 576).all()
    got = isomedia.probe(spark.createDataFrame([(bytearray(file), 1), (bytearray(file[:-5]), 2), (bytearray(b""), 3), (None, 4), (bytearray(b"\0\0\0\1mdat" + bytes(8)), 5)], "media binary, tracks int")).collect()
    assert got[0]["tracks"][0]["key_ranges"][1]["size"] == 576 and got[0]["media_error"] is None
    assert all(r["tracks"] is None and r["media_error"] for r in got[1:])


def test_fragmented_media_are_reported(spark):
    file = isomedia.mux(bytes(576))
    at = file.rindex(b"moov") - 4
    box = lambda kind, content: (8 + len(content)).to_bytes(4, "big") + kind + content
    extended = file[:at] + box(b"moov", file[at + 8 :] + box(b"mvex", box(b"trex", bytes(24))))
    fragment = file + box(b"moof", box(b"mfhd", bytes(8)))
    got = isomedia.probe(spark.createDataFrame([(bytearray(file),), (bytearray(extended),), (bytearray(fragment),)], "media binary")).collect()
    assert got[0]["media_error"] is None and all(r["tracks"] is None and "fragmented" in r["media_error"] for r in got[1:])


def test_statistics(docs):
    got = Counter(tuple(r) for r in decision_list.with_statistics(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(SPACE, t)
        times = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if times[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        want[r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)] += 1
    assert got == want


def test_a_planted_rule_is_learned(spark):
    r = random.Random(2)
    rows = []
    for k in range(900):
        bad = r.random() < 0.25
        rows.append((k, " ".join(f"{w}{'#' * bad}" for w in words(40, k)), int(not bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    judged = decision_list.judge(table.drop("quality"), table.select("doc_id", "quality").union(spark.createDataFrame([(1, None)], "doc_id long, quality int")))
    wrong = judged.join(table, "doc_id").where(F.col("kept") != (F.col("quality") == 1)).count()
    assert wrong == 0


def test_no_labels_keep_all_but_base(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] == (not r["base_failed"]) for r in decision_list.judge(docs, labels).collect())
    assert decision_list.judge(empty, labels).count() == 0


def test_licenses(spark, empty):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore; CC BY-NC!"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "this work licensed under the gnu general public license version"),
        (4, None),
        (5, "under the mit\nlicense mit"),
        (6, "the terms of the work"),
        (7, "rights all reserved"),
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore; CC BY-NC!"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_join.scan(table).collect()}
    assert license_join.scan(table).count() == 8
    assert (got[1]["base_labels"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["score"]) == ("apache-2,cc-by-nc", 2, 5, 11, 1.0)
    assert (got[2]["labels"], got[2]["base_labels"], got[2]["score"]) == ("gpl-3", "", 1.0)
    assert got[3]["labels"] == "gpl-3" and 0.8 <= got[3]["score"] < 1
    assert (got[4]["n_words"], got[4]["labels"], got[4]["first_word"]) == (0, "", None)
    assert (got[5]["base_labels"], got[5]["first_word"]) == ("mit", 0)
    assert got[6]["labels"] == "" and got[7]["labels"] == "all-rights-reserved"
    assert license_join.scan(empty).count() == 0


@pytest.mark.parametrize("length", [1, 2, 4, 5, 6, 7, 20, 60, 99, 100, 101, 102, 150, 200, 300])
def test_lines_of_any_length(spark, length):
    """A line's length and breaks decide nothing: windows alone do."""
    r = random.Random(length)
    vocabulary = sorted({w for t in license_join.TEMPLATES.values() for x in t for w in x.split()})
    notice = "released under the mit license".split()
    rows, spread = [], words(length, 7)
    for k, w in enumerate(notice):  # the same words all over a line
        spread[k * length // len(notice)] = w
    rows.append((0, " ".join(spread)))
    at = r.randrange(max(1, length - 4))
    rows.append((1, " ".join([*words(length, 8)[:at], *notice, *words(length, 9)[at + 5 :]])))
    rows += [(k, " ".join(r.choices(vocabulary if k % 2 else r.choice(r.choice(list(license_join.TEMPLATES.values()))).split(), k=length))) for k in range(2, 14)]
    rows += [(k + 100, re.sub(" ", lambda _: r.choice(" \n"), t)) for k, t in rows]
    got, table = {}, spark.createDataFrame(rows, "doc_id long, text string")
    for x in license_join.similar_windows(table, ["doc_id"]).collect():
        place = (x["doc_id"], x["license"], x["template"])
        got[place] = max(got.get(place, 0), round(x["containment"], 9))
    assert got == {(k, n, t): c for k, text in rows for n, t, c in windows_by_force(text)}
    labels = {x["doc_id"]: (x["labels"], x["score"]) for x in license_join.scan(table.where("doc_id < 2")).collect()}
    assert labels[1] == ("mit", 1.0)
    assert length < 8 or labels[0] == ("", 0.0)


def wrapped(notice, width):
    return textwrap.fill(notice, width, initial_indent=" * ", subsequent_indent=" * ", break_long_words=False)


@pytest.mark.parametrize("width", [20, 44, 72])
def test_wrapped_notices(spark, width):
    notices = {
        "apache-2": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,",
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "gpl-3": "This work is licensed under the GNU General Public License version 3",
    }
    filler = " ".join(words(60, 5))
    rows = [(k, f"{filler}\n\n{wrapped(n, width)}\n\n{filler}") for k, n in enumerate(notices.values())]
    rows.append((len(rows), "This work is\nlicensed under the GNU General Public License version 3"))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (n, 1.0) for k, n in enumerate([*notices, "gpl-3"])}


def test_notices_of_unequal_containment_in_one_line(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
    apache = "Licensed under the Apache Licence, Version 2.0."  # one word of eight is another
    gpl, agpl = "This work is licensed under the GNU General Public License version 3.", "Licensed under the GNU Afero General Public License version 3."
    filler = " ".join(words(50, 8))
    rows = [
        (1, f"{mit} {apache}"),
        (2, f"{filler} {apache} {filler} {mit} {filler}"),
        (3, f"{gpl} {filler} {agpl}"),  # the second shares nine of its ten words with the first, at another place
        (4, f"{filler} {gpl} {filler}"),
        (5, f"{gpl} {agpl}"),
    ]
    got = {r["doc_id"]: r["labels"] for r in license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "apache-2,mit", 2: "apache-2,mit", 3: "agpl-3,gpl-3", 4: "gpl-3", 5: "agpl-3,gpl-3"}


def test_words_scattered_over_a_long_line_are_no_notice(spark):
    r = random.Random(2)
    scattered = words(300, 3)
    for w in "all rights reserved released under the mit license".split():
        scattered.insert(r.randrange(len(scattered)), f"x {w} y {w[::-1]}")
    rows = [(1, " ".join(scattered)), (2, " ".join(words(200, 4)) + " All rights reserved " + " ".join(words(200, 5)))]
    got = {x["doc_id"]: x["labels"] for x in license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "all-rights-reserved"}


def windows_by_force(text, percent=80):
    """Templates that some window of the text holds."""
    own, out = re.findall("[a-z0-9]+", text.lower()), set()
    for name, templates in license_join.TEMPLATES.items():
        for number, t in enumerate(templates):
            want, span = set(t.split()), -(-len(t.split()) * 100 // percent)
            share = max((len(want & set(own[k : k + span])) / len(want) for k in range(len(own))), default=0)
            if share * 100 >= percent:
                out.add((name, number, round(share, 9)))
    return out


def test_license_windows_equal_brute_force(spark):
    r = random.Random(6)
    notices = [t.split() for x in license_join.TEMPLATES.values() for t in x]
    rows = []
    for k in range(80):
        own = words(r.randrange(40), k)
        for _ in range(3):
            own += [w for w in r.choice(notices) if r.random() < 0.9] + words(r.randrange(30), r.random())
        rows.append((k, "".join(w + r.choice("    \n") for w in own)))
    got = {}
    for x in license_join.similar_windows(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect():
        place = (x["doc_id"], x["license"], x["template"])
        got[place] = max(got.get(place, 0), round(x["containment"], 9))
    assert got == {(k, n, t): c for k, text in rows for n, t, c in windows_by_force(text)} and got


def test_language_of_held_out_documents(spark):
    found = queries.op10_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edge_cases(spark, docs, empty):
    model = langid.fit(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame([(1, None), (2, "12 !"), (3, "the dog"), (4, "")], "doc_id long, text string"), model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4)] == ["und", "und", "en", "und"] and got[1]["lang_rejected"]
    nothing = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_language_training_with_copies_rare_languages_and_long_texts(spark):
    r = random.Random(12)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "rare": "opqrstu", "long": "vwxyzäö"}
    text = lambda lang, n: " ".join("".join(r.choices(letters[lang], k=5)) for _ in range(n))
    rows = [(text(lang, 20), lang) for lang in ("aa", "bb") for _ in range(400)]
    rows += [(text("rare", 20), "rare") for _ in range(3)] + [(text("long", 4000), "long") for _ in range(2)]
    table = spark.createDataFrame(rows, "text string, lang string")
    first = table.where("lang = 'aa'").orderBy(F.xxhash64("text", "lang")).first()
    copies = spark.createDataFrame([tuple(first)] * 200, table.schema)
    model = langid.fit(table.unionByName(copies), rows=60)
    assert model.languages == sorted(letters)
    counts, _, langs = langid.training_vectors(table.unionByName(copies), 4096, 60)
    assert len(np.unique(counts, axis=0)) == len(counts) == 60
    assert Counter(langs.tolist()) == {"aa": 27, "bb": 28, "rare": 3, "long": 2}
    fresh = [(lang, text(lang, 20)) for lang in letters for _ in range(20)]
    found = langid.identify(spark.createDataFrame(fresh, "lang string, text string"), model).collect()
    assert all(x["lang_pred"] == x["lang"] and not x["lang_rejected"] for x in found)


def test_language_fit_holds_parts_of_the_vectors(spark):
    r = random.Random(8)
    rows = [(" ".join("".join(r.choices(f"{lang}xyz", k=4)) for _ in range(30)), lang) for lang in "abcd" for _ in range(400)]
    table = spark.createDataFrame(rows, "text string, lang string")
    tracemalloc.start()
    model = langid.fit(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * len(rows) * langid.DIMS * 4  # all vectors at once, with what scales them, are five times these bytes
    counts, letters, langs = langid.training_vectors(table, langid.DIMS, langid.TRAIN_ROWS)
    x = langid.scale(counts, np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)).astype(np.float32)
    assert np.array_equal(model.centroids, np.concatenate([langid.spherical_kmeans(x[langs == lang], langid.CENTROIDS) for lang in "abcd"]).astype(np.float32))
    assert np.allclose(model.nearest[model.nearest > 0], (x @ model.centroids.T).max(axis=1).min(), atol=1e-6)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out.persist()
    groups = groups_by_force(docs.collect(), 5)
    assert all(a == c or c is None for a, _, c in groups)  # no near duplicates are left
    pieces = cp.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
