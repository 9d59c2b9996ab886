"""Corpus operators on odd input: clashing names, hostile files, frequent keys, very long texts; and the pipeline."""

import random
import re
import struct
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decision_list, isomedia, langid, license_join, line_dedup, mixing, near_dup, packing, rans, skew, storage, token_counts

from helpers import SF, VOCABULARY, groups_by_force, library, words

CLASHES = {"n_tokens": 7, "posterior": "p", "n_words": "w", "kept": False, "rule": 9, "lang_pred": "xx", "lines_removed": -1, "id": 1, "node": 2, "rate": 0.0, "label": 3}


def clashing(df, **more):
    """The table with columns that have the names of results."""
    return df.withColumns({n: F.lit(x) for n, x in (CLASHES | more).items()})


@pytest.fixture
def frequent_at_two(monkeypatch):
    """Every key with more than two rows counts as frequent."""
    real = skew.frequent_keys
    few = lambda counts, least, most=skew.MOST_KEYS: real(counts, 2, most)
    monkeypatch.setattr(skew, "frequent_keys", few)
    monkeypatch.setattr(near_dup, "LIST_BLOCK", 3)


def test_near_duplicates_with_frequent_keys(spark, frequent_at_two):
    """A shingle in all texts, a passage in a third of them, a large group of near copies, and equal ids with different texts."""
    r, rows = random.Random(4), []
    shared, passage, base = words(4, 1), words(40, 2), words(60, 3, 5000)
    for k in range(90):
        if k % 3 == 0:
            own = list(base)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        else:
            own = words(r.randrange(5, 60), k, 5000) + (passage if k % 3 == 1 else [])
        rows.append((k if k < 85 else 3, " ".join(own + shared)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dup.near_duplicates(table, width=4).collect()
    want = groups_by_force(table.collect(), 4)
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == want


def test_cross_pairs_in_blocks_lose_none(spark, frequent_at_two):
    """One list of many different sets: all pairs at the similarity come out, and only pairs of different components."""
    r = random.Random(6)
    common = list(range(20))
    sets = [sorted({*common, *(100 + r.randrange(12) for _ in range(6))}) for _ in range(25)]
    table = spark.createDataFrame([(k, bytearray(np.array(s, "<i8").tobytes())) for k, s in enumerate(sets)], "node long, hashes binary")
    roots = spark.createDataFrame([(k, k // 2) for k in range(25)], "node long, root long")
    got = {(x["a"], x["b"]) for x in near_dup.cross_pairs(table, roots, 80).collect()}
    want = {(a, b) for a in range(25) for b in range(a + 1, 25) if a // 2 != b // 2 and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert want and want <= got and all(a // 2 != b // 2 for a, b in got)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_classes_lose_no_pair(spark, percent):
    """Pairs of classes are those that hold two members that size and place leave possible, in different components."""
    r = random.Random(percent)
    rows = [(v, k, r.randrange(6) if v else 0, r.choice((1, 2, 8, 10, 40, 50)), r.randrange(4)) for v in range(6) for k in range(r.randrange(1, 30))]
    rows = [x for x in rows if x[4] < x[3]]
    found = {tuple(x) for x in near_dup.class_pairs(spark.createDataFrame(rows, "v long, node long, root long, size int, place int"), percent).select("v", "x_size", "x_place", "y_size", "y_place").collect()}
    want = set()
    for v, n, root, size, place in rows:
        for v2, n2, root2, size2, place2 in rows:
            if v == v2 and n != n2 and root != root2 and (size, place) <= (size2, place2) and min(size - place, size2 - place2) * (100 + percent) >= percent * (size + size2):
                want.add((v, size, place, size2, place2))
    assert want <= found and want
    assert not [x for x in found - want if x[0] == 0]


def test_templated_texts_make_no_pairs(spark):
    """Short texts that share all words but one: one long list, no pair of it can reach the similarity."""
    sets = [[*range(6), 1000 + k] for k in range(3000)]
    table = spark.createDataFrame([(k, bytearray(np.array(s, "<i8").tobytes())) for k, s in enumerate(sets)], "node long, hashes binary")
    roots = spark.range(3000).selectExpr("id AS node", "id AS root")
    assert near_dup.cross_pairs(table, roots, 80).count() == 0


def test_line_windows_that_are_frequent(spark, frequent_at_two):
    rows = [(k, "\n".join(["h1", "h2", "h3", *(f"own {k} {j}" for j in range(k % 4)), *(["t1", "t2", "t3", "t4"] if k % 2 else [])])) for k in range(30)]
    seen, want = set(), {}
    for k, text in rows:
        lines = text.split("\n")
        gone = {j for at in range(len(lines) - 2) if tuple(lines[at : at + 3]) in seen for j in range(at, at + 3)}
        seen |= {tuple(lines[at : at + 3]) for at in range(len(lines) - 2)}
        want[k] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want


@pytest.mark.parametrize("entries", [0, 3, 100_000])
def test_long_and_frequent_pretokens(spark, monkeypatch, entries):
    monkeypatch.setattr(token_counts, "FREQUENT_ENTRIES", entries)
    tk, long = library(), "q" * 80 + "7" * 3
    rows = [(k, f"{long} " * (k % 3) + f"{'z' * 70} tail {k} {'=' * (60 + k)}") for k in range(40)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).collect()}
    assert got == {k: len(tk.encode(t, add_special_tokens=False).ids) for k, t in rows}


def test_samples_are_bounded_and_the_smallest(spark):
    df = spark.createDataFrame([(k % 40, k) for k in range(2000)], "doc_id long, n long")
    want = [(r["doc_id"], r["n"]) for r in df.orderBy(skew.hash_share("doc_id"), "n").limit(120).collect()]
    assert [(r["doc_id"], r["n"]) for r in skew.smallest_hashes(df, 120, "doc_id", ["n"]).collect()] == want
    assert skew.smallest_hashes(df, 5000, "doc_id", ["n"]).count() == 2000 and skew.smallest_hashes(df.where("false"), 5, "doc_id", ["n"]).count() == 0


def test_tables_are_deleted_after_their_scope(spark, tmp_path):
    kept = []
    with storage.scratch(spark, kept):
        kept.append(storage.stored(spark.range(3), "kept"))
        other = storage.stored(spark.range(4), "other")
        assert other.count() == 4
    assert kept[0].count() == 3 and other.inputFiles() and not any(p.endswith(other.inputFiles()[0].rsplit("/", 2)[1]) for p in storage._made)
    with pytest.raises(Exception):
        spark.read.parquet(other.inputFiles()[0].rsplit("/", 1)[0])


def nested(depth):
    out = b""
    for _ in range(depth):
        out = struct.pack(">I4s", 8 + len(out), b"moov") + out
    return out


def patched(file, kind, at, value):
    place = file.rindex(kind) + 4 + at
    return file[:place] + struct.pack(">I", value) + file[place + 4 :]


def test_hostile_media_are_reported(spark):
    file = isomedia.mux(bytes(576 * 4))
    hostile = [
        nested(3000),
        patched(file, b"stsz", 8, 0xFFFFFFFF),  # samples
        patched(file, b"stsz", 4, 0xFFFFFFFF),  # their size
        patched(file, b"stsc", 12, 0xFFFFFFFF),  # samples of a chunk: more than there are, which is no damage
        patched(file, b"stsc", 8, 0),  # chunks are numbered from 1
        patched(file, b"stco", 8, 0xFFFFFF00),  # outside the file
        patched(file, b"stco", 4, 0xFFFFFFF0),  # chunks
        patched(file, b"stss", 4, 0x7FFFFFFF),
        patched(file, b"stts", 4, 0x7FFFFFFF),
        b"\0\0\0\1moov" + struct.pack(">Q", 1 << 62),
    ]
    got = isomedia.probe(spark.createDataFrame([(k, bytearray(h)) for k, h in enumerate(hostile)], "k int, media binary")).orderBy("k").collect()
    assert [r["media_error"] is None for r in got] == [k == 3 for k in range(len(hostile))]
    r = random.Random(3)
    for _ in range(300):  # any damage is an error or a result, never another exception
        damaged = bytearray(file)
        for _ in range(4):
            damaged[r.randrange(len(file) - 700, len(file))] = r.randrange(256)
        try:
            isomedia.parse(bytes(damaged))
        except ValueError:
            pass


def test_packing_over_many_partitions(spark):
    r = random.Random(1)
    rows = [(k, " ".join(words(r.choice([3, 40, 200, 900]), k))) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    made = {}
    for parts in (1, 24):
        out = packing.pack(table.repartition(parts), VOCABULARY, capacity=512, open_bins=64).collect()
        bins = Counter()
        for x in out:
            bins[x["sequence_id"]] += x["length"]
        assert max(bins.values()) <= 512
        made[parts] = len(bins) / -(-sum(bins.values()) // 512)
    assert made[24] <= made[1] + 0.02
    assert packing.pack(table.where("false"), VOCABULARY).count() == 0


def test_judging_replaces_clashing_columns(spark):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet"), word_chars="c", quality=5)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = {r["doc_id"]: (r["n_words"], r["kept"], r["rule"]) for r in decision_list.judge(docs.select("doc_id", "text"), labels).collect()}
    out = decision_list.judge(docs, labels, keep=docs.columns)
    assert {r["doc_id"]: (r["n_words"], r["kept"], r["rule"]) for r in out.collect()} == plain
    assert len(out.columns) == len(set(out.columns)) and out.first()["quality"] == 5


def test_verdicts_follow_the_learned_rules(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = decision_list.with_statistics(docs, ["doc_id"]).persist()
    rules = decision_list.learn(stats.join(labels.select("doc_id", "quality"), "doc_id").where(~decision_list.base_failed()))
    assert rules
    for r in decision_list.judge(docs, labels).collect():
        hit = [k for k, rule in enumerate(rules, 1) if all((r[c.feature] >= c.threshold) == c.at_least for c in rule)]
        base = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert (r["rule"], r["base_failed"], r["kept"]) == (hit[0] if hit else 0, base, not base and not hit)


def test_languages_by_an_independent_search(spark):
    """The nearest centroid in plain Python, from n-grams counted one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in langid.identify(docs, model).collect():
        text = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in r["text"] or "").lower()
        raw, counts = re.sub(" +", " ", text).encode(), np.zeros(langid.DIMS)
        for n in (1, 2, 3):
            for k in range(len(raw) - n + 1):
                gram = int.from_bytes(raw[k : k + n], "big")
                counts[(((gram * 2654435761 + (n * 0x9E3779B1 & 0xFFFFFFFF)) & 0xFFFFFFFF) >> 20) % langid.DIMS] += 1
        x = np.log1p(counts) * model.idf
        cosine = model.centroids @ (x / max(np.linalg.norm(x), 1e-12))
        best = int(cosine.argmax())
        if sorted(cosine)[-1] - sorted(cosine)[-2] > 1e-4 and text.strip():
            assert r["lang_pred"] == model.languages[model.owner[best]]
            assert r["lang_score"] == pytest.approx(float(cosine[best]), abs=1e-4)


def test_centroids_are_those_of_the_training_texts(spark):
    """Each centroid is the scaled mean of the training texts of its language that are nearest to it."""
    x = np.abs(np.random.default_rng(5).normal(size=(80, 16)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid.spherical_kmeans(x, 3, 60)
    own = (x @ c.T).argmax(axis=1)
    for j in range(3):
        mean = x[own == j].mean(axis=0)
        assert np.allclose(c[j], mean / np.linalg.norm(mean))


LONG = " ".join(f"word{k % 5000}" for k in range(300_000)) + "\nunder the mit license"


def test_very_long_texts(spark):
    table = spark.createDataFrame([(1, LONG), (2, LONG), (3, "short one")], "doc_id long, text string")
    n = len(library().encode(LONG, add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(table, VOCABULARY).collect()}[1] == n
    assert {r["doc_id"]: r["n_tokens"] for r in rans.encode_decode(table, VOCABULARY, 50_257).collect()}[2] == n + 1
    assert packing.pack(table, VOCABULARY).where("doc_id = 1").agg(F.sum("length")).first()[0] == n + 1
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(table).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["n_words"] for r in decision_list.with_statistics(table, ["doc_id"]).collect()}[1] == 300_004
    assert {r["doc_id"]: r["base_labels"] for r in license_join.scan(table).collect()} == {1: "mit", 2: "mit", 3: ""}
    assert {r["doc_id"]: r["n_bytes"] for r in isomedia.text_media_digests(table).collect()}[1] == len(LONG.encode())
    assert line_dedup.dedup_lines(table).where("lines_removed > 0").count() == 0
    assert langid.identify(table, langid.fit(table.withColumn("lang", F.lit("en")))).where("lang_pred = 'en'").count() == 3


def test_letters_that_lower_to_ascii_stay_apart(spark):
    rows = [(1, "under the MIT LICENSE"), (2, "under the mİt license"), (3, "under the mit Kicense ÄÖ")]
    got = {r["doc_id"]: r["base_labels"] for r in license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "", 3: ""}
    assert [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").orderBy("doc_id").select(license_join.words_of(F.col("text"))).collect()][2] == ["under", "the", "mit", "Kicense", "ÄÖ"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns that clash with results."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(None, None), (None, "a b c\nd e f\ng h i"), (900_001, None), (900_002, ""), (900_003, " \n\n "), (900_004, "1 2 3 4 5"), (900_005, LONG[:200_000]), (900_005, LONG[:200_000]), (900_006, "the same id, one text"), (900_006, "and the same id with quite another text in it")]
    extra = spark.createDataFrame([(d, t, "en" if d else None, None, None) for d, t in more], docs.schema)
    return clashing(docs.unionByName(extra)).persist()


def test_stages_on_odd_documents(spark, odd):
    import corpus_pipeline as cp

    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, SF)
        rows = out.collect()
        assert out.columns == odd.columns, name
        assert all((r["n_tokens"], r["posterior"], r["n_words"], r["kept"], r["rate"], r["lines_removed"]) == (7, "p", "w", False, 0.0, -1) for r in rows), name
        if name == "line_dedup":
            assert len(rows) == odd.count()
        if name == "language":
            assert not [r for r in rows if r["text"] is None or not any(c.isalpha() for c in r["text"])]
        if name == "near_dup":
            assert sum(r["doc_id"] == 900_005 for r in rows) == 1 and sum(r["doc_id"] == 900_006 for r in rows) == 2
        assert stage(spark, odd.where("false"), SF).count() == 0, name
    packed = cp.STAGES[-1][1](spark, odd, SF)
    assert packed.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert cp.STAGES[-1][1](spark, odd.where("false"), SF).count() == 0


def test_the_whole_pipeline(spark):
    """The packed pieces are those of the documents that the stages keep, one after another, with their tokens."""
    import zlib

    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
    tk, want = library(), Counter()
    for r in docs.collect():
        ids = [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        start = 0
        for piece, size in enumerate(packing.piece_sizes(len(ids), 2048)):
            want[r["doc_id"], piece, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())] += 1
            start += size
    before = len(storage._made)
    got = cp.run(spark, SF)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == want
    assert len(storage._made) == before + 1  # the result alone is left


ODD_NAMES = ["Rate", "Lang_Pred", "N_Words", "LINES_REMOVED", "tm_at", "tm_doc", "meta.url", "a`b", "Text", "DOC_ID", "tm_0", "Kept", "taken "]


@pytest.fixture(scope="module")
def oddly_named(spark):
    """Documents with columns whose names differ from results only in case, hold dots or look internal."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in ODD_NAMES]).persist()


def kept_as_they_were(out, names, at):
    """Every named column holds what its row had."""
    rows = out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect()
    places = [out.columns.index(n) for n in names]
    return rows and all(r[p] == f"{n}:{r[at]}" for r in rows for n, p in zip(names, places, strict=True))


def test_operators_on_odd_names(spark, oddly_named):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    free = lambda made: [n for n in ODD_NAMES if n.lower() not in made]
    found = langid.identify(oddly_named, langid.fit(spark.read.parquet(f"{SF}/documents.parquet")))
    assert "Lang_Pred" not in found.columns and found.columns[-3:] == ["lang_pred", "lang_score", "lang_rejected"]
    assert kept_as_they_were(found, free({"lang_pred"}), 0)
    lines = line_dedup.dedup_lines(oddly_named)
    assert [c for c in lines.columns if c.lower() == "lines_removed"] == ["lines_removed"]
    assert kept_as_they_were(lines, free({"lines_removed"}), 0)
    judged = decision_list.judge(oddly_named, labels, keep=oddly_named.columns)
    assert [c for c in judged.columns if c.lower() in ("n_words", "kept")] == ["n_words", "kept"]
    assert kept_as_they_were(judged, free({"n_words", "kept"}), 0)
    mixed = mixing.mix(oddly_named, mixing.label_domains(labels), keep=oddly_named.columns)
    assert [c for c in mixed.columns if c.lower() == "rate"] == ["rate"]
    assert kept_as_they_were(mixed, free({"rate"}), 0)


def test_stages_on_odd_names(spark, oddly_named):
    import corpus_pipeline as cp

    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, oddly_named, SF)
        assert out.columns == oddly_named.columns, name
        assert kept_as_they_were(out, ODD_NAMES, 0), name
    assert cp.STAGES[-1][1](spark, oddly_named, SF).select("doc_id").distinct().count() == oddly_named.count()


def test_labels_of_unknown_documents_use_up_no_sample(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TRAIN_ROWS", 60)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    strange = spark.range(10**6, 10**6 + 5000).selectExpr("id AS doc_id", "'good' AS domain")
    a, b = (sorted(map(tuple, mixing.mix(docs, x).select("doc_id", "rate").collect())) for x in (labels, labels.unionByName(strange)))
    assert a == b
