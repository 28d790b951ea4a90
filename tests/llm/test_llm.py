"""Corpus operators against plain versions, planted cases and edge cases."""

from __future__ import annotations

import base64
import hashlib
import pickle
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.llm import bpe, chat, common, components, decontam, langid, media, pii, quality, sharding, simhash, suffix_dedup
from querent.llm import queries as Q

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en", first=0):
    return spark.createDataFrame([(first + i, t, lang, f"src{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)], DOC)


def clashing(df):
    """The same rows with columns that operators add, or use inside."""
    return df.select("*", *[F.lit(1).alias(c) for c in ("ids", "keep", "lang_pred", "base_spans", "fp", "shard", "_row", "d", "u", "k", "row", "_d", "_u", "_k", "slot", "h")])


def prose(seed, n, words=None):
    r = random.Random(seed)
    words = words or ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


EDGE = [None, "", " \n", "a", "x" * 5000, "é" * 300, "ab " * 2000, "same text twice, long enough to matter", "same text twice, long enough to matter"]


# 1


def test_media_finds_edited_copies_and_no_others(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(30):
        im = media.render(r.standard_normal(64).tolist())
        rows.append((i, bytearray(media.encode(im))))
        if i < 5:
            edit = im.copy()
            edit[20:34, 20:34] = 255
            for k, x in enumerate((im[12:, 6:], np.rot90(im).copy(), media.resize(im, 1.33).astype(np.uint8), edit, im)):
                rows.append((1000 + 10 * i + k, bytearray(media.encode(x))))
    rows += [(5000, None), (5001, bytearray(b"not an image")), (5002, None), (0, rows[0][1])]
    got = media.copies(spark.createDataFrame(rows, "image_id long, image binary").withColumn("pixels", F.lit(1))).collect()
    of = {x.image_id: x.class_id for x in got}
    assert len(got) == len(rows)
    assert all(of[1000 + 10 * i + k] == i for i in range(5) for k in range(5))
    assert all(of[i] == i for i in range(30)) and of[5002] == 5000 and of[5001] == 5001


def test_media_of_nothing(spark):
    assert media.copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_consensus_in_a_crowded_bucket(spark):
    im = media.render(np.random.default_rng(9).standard_normal(64).tolist())
    rows = []
    for i in range(40):
        x = im.copy()
        x[i, :3] = i  # all differ, all look alike
        rows.append((i, bytearray(media.encode(x))))
    assert {x.class_id for x in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()} == {0}


def test_media_sends_an_image_once_to_a_cell(spark, monkeypatch):
    im = media.render(np.random.default_rng(9).standard_normal(64).tolist())
    rows = []
    for i in range(40):
        x = im.copy()
        x[i, :3] = i
        rows.append((i, bytearray(media.encode(x))))
    images = spark.createDataFrame(rows, "image_id long, image binary")
    made, plain = [], type(images).mapInArrow

    def noted(self, *given, **named):
        made.append(plain(self, *given, **named))
        return made[-1]

    monkeypatch.setattr(type(images), "mapInArrow", noted)
    monkeypatch.setattr(media, "PAIRS", 50)  # many packs of pairs name an image
    assert {x.class_id for x in media.copies(images).collect()} == {0}
    counts = [x.count() for x in made if {"cell", "v"} <= set(x.columns)]
    assert counts and max(counts) <= 40 * media.CELLS, counts


def classes_of(n, links):
    """Least member of each member's component."""
    lead = list(range(n))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        lead[y] = x
    return {i: root(i) for i in range(n)}


def linked_by_consensus(images):
    """Pairs that consensus links, of all pairs."""
    made = [media._unpack(media._pack(p), c.tobytes()) for p, c in map(media.describe, images)]
    n = len(images)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if media.consensus(made[a], made[b]) >= media.AGREE]


def test_media_recall_against_consensus_of_all_pairs(spark):
    r = np.random.default_rng(21)
    images = []
    for _ in range(16):
        im = media.render(r.standard_normal(64).tolist())
        noisy = [np.clip(im + r.normal(0, s, im.shape), 0, 255).astype(np.uint8) for s in (3, 10)]
        images += [im, im[9:, 5:], np.rot90(im).copy(), im[14:-14, 14:-14], *noisy, *[media.resize(im, s).astype(np.uint8) for s in (0.6, 0.75, 0.9, 1.1, 1.33, 1.6)]]
    links = linked_by_consensus(images)
    got = media.copies(spark.createDataFrame([(i, bytearray(media.encode(x))) for i, x in enumerate(images)], "image_id long, image binary")).collect()
    of = {x.image_id: x.class_id for x in got}
    together = np.mean([of[a] == of[b] for a, b in links])
    assert together > 0.99, together
    assert all(of[i] // 12 == i // 12 for i in of)  # nothing beside the copies is linked
    assert np.mean([of[i] == i // 12 * 12 for i in of]) > 0.98
    made = [media._unpack(media._pack(p), c.tobytes()) for p, c in map(media.describe, images)]
    keys = [set(media.table_keys(c).tolist()) for _, c in made]
    reached = np.mean([bool(keys[a] & keys[b]) for a, b in links])
    assert reached > 0.85, reached  # by pairs, before chains of links


def test_two_families_of_a_crowded_bucket_stay_apart_or_meet_as_consensus_says(spark):
    r = np.random.default_rng(4)
    patch = media.render(r.standard_normal(64).tolist())[30:62, 30:62]
    images = []
    for k in range(2):  # all 200 images share a patch, and so buckets; each family has a picture of its own
        im = media.render(r.standard_normal(64).tolist())
        im[30:62, 30:62] = patch
        for i in range(100):
            x = im.copy()
            x[i % 96, : 3 + i // 96] = i
            images.append(x)
    links = linked_by_consensus(images)
    got = {x.image_id: x.class_id for x in media.copies(spark.createDataFrame([(i, bytearray(media.encode(x))) for i, x in enumerate(images)], "image_id long, image binary")).collect()}
    assert got == classes_of(200, links)


# 2


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_equals_the_definition(spark, seed):
    r = random.Random(seed)
    base = [prose(s, 200) for s in range(4)]
    texts = {}
    for i in range(40):
        t = base[i % 4]
        a, b = sorted(r.sample(range(len(t)), 2))
        texts[i] = r.choice([t, t[a:b] + prose(100 + i, 20), prose(i, 30) + t[a:b], t[:a] + "é" + t[a:], "z" * r.randint(90, 400), t[a:b] * 2, "", None, base[0][:99], base[0][:100]])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.report(clashing(docs(spark, texts.values()).repartition(3))).collect()}
    assert got == suffix_dedup.plain(texts)


def test_suffix_dedup_across_pieces(spark, monkeypatch):
    t = prose(1, 9000)
    texts = {0: t, 1: "q" + t[100:-100], 2: t[:3000]}
    raw = [suffix_dedup.runs(x.encode()) for x in texts.values()]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    cutup = suffix_dedup.runs(t.encode())
    assert cutup[4].sum() == raw[0][4].sum() == len(t) - 99
    got = {x.doc_id: x.n_removed for x in suffix_dedup.report(docs(spark, texts.values())).collect()}
    assert got == {0: 0, 1: len(t) - 200, 2: 3000}


def test_suffix_dedup_repeated_rows_and_empty_tables(spark):
    t = prose(1, 60)
    twice = docs(spark, [t]).union(docs(spark, [t])).union(docs(spark, [t], first=5)).union(spark.createDataFrame([(None, t, "en", "s", 1)], DOC))
    got = sorted(((x.doc_id, x.n_removed) for x in suffix_dedup.report(twice).collect()), key=str)
    assert got == [(0, 0), (0, 0), (5, len(t)), (None, len(t))]
    assert suffix_dedup.report(twice.limit(0)).count() == 0


def test_suffix_dedup_keeps_no_shuffle_of_a_step_that_is_done(spark, monkeypatch):
    kept = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    common.release(spark)
    time.sleep(1)
    before, seen, windows = kept.size(), [], suffix_dedup._windows

    def after_runs(*given):
        time.sleep(1)
        seen.append(kept.size() - before)
        return windows(*given)

    monkeypatch.setattr(suffix_dedup, "_windows", after_runs)
    rows = suffix_dedup.report(docs(spark, [prose(1, 60), prose(1, 60), prose(2, 60)]))
    time.sleep(1)
    assert seen == [0] and kept.size() - before <= 1  # slots'
    assert [x.n_removed > 0 for x in rows.orderBy("doc_id").collect()] == [False, True, False]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_suffix_dedup_tells_texts_under_one_id_apart(spark, monkeypatch, doc_id):
    monkeypatch.setattr(suffix_dedup, "_TEXT_BITS", 1)  # tags clash as they do among many thousand texts
    shared = prose(1, 40)
    texts = [prose(10 + i, 12 + i) + (shared if i % 3 == 0 else "") for i in range(30)]
    d = spark.createDataFrame([(doc_id, t, "en", "s", len(t)) for t in texts], DOC)
    got = suffix_dedup.dedup(d.repartition(3)).collect()
    kept = Counter(bytes(x.kept).decode() for x in got)
    assert all(x.n_removed + len(x.kept) == x.n_bytes and x.n_removed in (0, *range(len(shared), len(shared) + 9)) for x in got)
    assert sum(shared in k for k in kept.elements()) == 1 and sum(x.n_removed > 0 for x in got) == 9
    assert all(kept[t] == 1 for i, t in enumerate(texts) if i % 3)


# 3


def test_quality_holds_out(spark, sf):
    # learned without every fourth label, tested on these
    d, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    test = labels.filter("doc_id % 4 = 1")
    got = quality.classify(d, labels.join(test, "doc_id", "left_anti")).join(test, "doc_id").collect()
    bad = [r.keep for r in got if r.quality == 0]
    good = [r.keep for r in got if r.quality == 1 and r.toxic == 0]
    toxic = [r.keep for r in got if r.toxic == 1]
    assert np.mean(bad) < 0.1 and np.mean(good) > 0.95 and np.mean(toxic) < 0.45


def test_rounds_take_the_most_confident_of_the_whole_corpus(spark, corpus, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = corpus.join(labels.filter("toxic is not null"), "doc_id").orderBy("doc_id").collect()
    made = [(*quality.content(r.text), quality.metadata(r.source, r.lang, r.n_chars)) for r in rows]
    heads = [quality.Head(made, np.array([float(x) for x in y]), e) for y, e in (([r.quality for r in rows], 20.0), ([r.toxic for r in rows], 12.0))]
    for h in heads:
        h.learn()
    d = corpus.union(corpus.limit(40)).select("*", F.xxhash64("text").alias("h")).repartition(5)
    known = [{r.h for r in d.limit(30).collect()} for _ in range(8)]
    got = quality.confident(d, heads, known)
    whole = sorted({(r.h, r.text, r.source, r.lang, r.n_chars) for r in d.collect()})
    features = [(*quality.content(t), quality.metadata(s, la, n)) for _, t, s, la, n in whole]
    for k, found in got.items():
        if heads[k // 4].constant:
            assert not found
            continue
        p = heads[k // 4].sure("AB"[k // 2 % 2], features)
        sure = {h: 0.0 for h, *_ in whole}
        for (h, *_), x in zip(whole, p if k % 2 else 1 - p, strict=True):
            sure[h] = max(sure[h], round(float(x), 9))
        want = sorted((h for h, x in sure.items() if x >= quality.CONFIDENT and h not in known[k]), key=lambda h: (-sure[h], h))[: quality.ADD]
        assert [h for h, _ in found] == want
    assert any(got.values())


def test_quality_sends_weights_and_no_texts(spark, sf, monkeypatch):
    """Workers hold what is broadcast: not the words of all labelled documents."""
    sent, kind = [], type(spark.sparkContext)
    broadcast = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, value: sent.append(len(pickle.dumps(value))) or broadcast(self, value))
    quality.learn(*[spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")])
    assert sent and max(sent) < 300_000, sent


def test_quality_edges(spark):
    d = docs(spark, EDGE)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.quality_score, r.toxic_score, r.keep) for r in quality.classify(clashing(d), none).collect()} == {(0.5, 0.0, True)}
    nulls = spark.createDataFrame([(i, None, None) for i in range(5)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(d, nulls).count() == len(EDGE)
    heads = quality.learn(d, none)
    assert quality.keep(clashing(d), heads).columns == clashing(d).columns
    assert quality.classify(d.limit(0), none).count() == 0


# 4


def test_sharding_is_exact_and_gapless(spark, corpus):
    got = sharding.assign(clashing(corpus), 24).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == corpus.count() and max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    text = {r.doc_id: r.text for r in corpus.collect()}
    import zlib

    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode())) for r in got)
    assert got == sharding.assign(corpus.repartition(5), 24).collect() or sorted(got) == sorted(sharding.assign(corpus.repartition(5), 24).collect())


def test_sharding_edges(spark):
    d = docs(spark, EDGE).union(docs(spark, EDGE))
    got = sharding.assign(d, 24).collect()
    assert len(got) == len(EDGE) * 2 and max(Counter(r.shard for r in got).values()) == 1
    assert {r.size for r in got if r.text_crc32 == 0} == {8}
    assert sharding.assign(d.limit(0)).count() == 0


def test_matrix_margins_and_law():
    m = sharding.matrix([5, 0, 17, 3], 4, 1)
    assert [sum(r) for r in m] == [5, 0, 17, 3] and sorted(map(sum, zip(*m, strict=True))) == [6, 6, 6, 7]
    r = random.Random(3)
    draws = [sharding.hypergeometric(r, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.12 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


def test_shards_are_uniform(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = np.array([(r.doc_id, r.shard, r.slot) for r in sharding.assign(d, 8).collect()])
    table = np.histogram2d(got[:, 0], got[:, 1], bins=[8, 8])[0]
    assert ((table - 62.5) ** 2 / 62.5).sum() < 100  # chi-square, 49 degrees of freedom
    assert abs(np.corrcoef(got[:, 0], got[:, 2])[0, 1]) < 0.06


# 5


def test_decontamination_finds_planted_passages(spark):
    items = [prose(500 + i, 20 + 3 * i) for i in range(15)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(98, None), (99, "too short")], "item_id long, text string")
    r = random.Random(5)
    texts, want = [], set()
    for i in range(120):
        t = prose(1000 + i, 300)
        if i < 45:
            w = items[i % 15].split()
            if i >= 30:  # reworded: a tenth of the words replaced, one inserted
                for k in r.sample(range(len(w)), max(1, len(w) // 10)):
                    w[k] = "other"
                w.insert(len(w) // 2, "indeed")
            elif i >= 15:
                w = [x.upper() + "," for x in w]
            cut = t.split()
            at = r.randrange(len(cut))
            t = " ".join([*cut[:at], *w, *cut[at:]])
            want.add((i, i % 15))
        texts.append(t)
    d = docs(spark, [*texts, None, "", " "])
    assert {(x.doc_id, x.item_id) for x in decontam.matches(clashing(d), bench).collect()} == want
    kept = decontam.clean(clashing(d), bench)
    assert kept.columns == clashing(d).columns and {x.doc_id for x in kept.collect()} == set(range(45, 123))


def test_decontamination_against_substrings(spark, sf):
    path = sf.replace("0.001", "0.01")
    d, b = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "benchmark"))
    found = {(x.doc_id, x.item_id) for x in decontam.matches(d, b).collect()}
    texts, items = [(x.doc_id, x.text) for x in d.collect()], [(x.item_id, x.text) for x in b.collect()]
    assert {(i, k) for i, t in texts for k, s in items if s in t} <= found
    clean = {i for i, t in texts if not any(s.lower()[:40] in t.lower() or s.lower()[-40:] in t.lower() for _, s in items)}
    assert not {i for i, _ in found} & clean


def test_decontamination_finds_items_in_lists(spark):
    items = [prose(700 + i, 17 + i % 14) for i in range(200)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    lists = [[(10 * i + 37 * k) % 200 for k in range(10)] for i in range(20)]
    d = docs(spark, [" ".join(items[k] for k in own) for own in lists] + [prose(2000 + i, 300) for i in range(100)])
    want = {(i, k) for i, own in enumerate(lists) for k in own}
    assert {(x.doc_id, x.item_id) for x in decontam.matches(d, bench).collect()} == want


def sentences(seed, n, words):
    """Prose in sentences, so that an item's answer is its last one."""
    w = prose(seed, n, words).split()
    return " ".join(x + "." if k % 9 == 8 else x for k, x in enumerate(w)) + "."


def test_paraphrase_recall_against_lcs_of_all_windows(spark):
    r = random.Random(17)
    common = [f"c{k}" for k in range(60)]
    rare = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9))) for _ in range(3000)]
    vocabulary = [*common * 40, *rare]  # nearly half of all words are one of sixty
    items = [sentences(3000 + i, 14 + i % 60, vocabulary) for i in range(60)]
    texts = []
    for i in range(400):
        t = prose(4000 + i, r.randint(20, 260), vocabulary).split()
        if i % 2 == 0:  # an item with up to half of its words reworded, dropped or doubled
            w = items[i % 60].split()
            for k in r.sample(range(len(w)), int(len(w) * r.random() * 0.5)):
                w[k] = r.choice([r.choice(common), r.choice(rare), "", f"{w[k]} {r.choice(common)}"])
            at = r.randrange(len(t))
            t[at:at] = w
        texts.append(" ".join(t))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.matches(docs(spark, texts), bench).collect()}
    plain = decontam.Items(list(enumerate(items)))
    want = set()
    for j, t in enumerate(texts):
        w = decontam.words_of(t)
        for k, own in enumerate(plain.words):
            reach = plain.size[k] * decontam.BLOCK
            if sum(map(set(w).__contains__, own)) < 0.5 * len(own):
                continue
            for at in range(0, max(1, len(w) - reach + decontam.BLOCK), decontam.BLOCK):
                part = w[max(0, at) : at + reach]
                if decontam.confirms(decontam.lcs(own, part) / len(own), decontam.lcs(plain.answers[k], part) / len(plain.answers[k])):
                    want.add((j, plain.ids[k]))
    assert len(want) > 130 and got <= want, (len(want), got - want)
    assert len(got & want) / len(want) > 0.9, len(got & want) / len(want)


def test_short_items_match_word_for_word(spark):
    bench = spark.createDataFrame([(1, "Mount Zagoria?"), (2, "..."), (3, "quokka")], "item_id long, text string")
    d = docs(spark, ["They saw mount  zagoria, then left", "mount of zagoria", "a QUOKKA", "zagoria mount", prose(1, 50)])
    assert {(x.doc_id, x.item_id) for x in decontam.matches(d, bench).collect()} == {(0, 1), (2, 3)}


def test_foreign_text_is_read_in_bounded_chunks():
    import pyarrow as pa

    lookup = decontam.Lookup(np.arange(1, 5, dtype=np.uint64))
    text = prose(5, 60_000)
    sizes = [n for _, _, n in decontam.passages((pa.RecordBatch.from_pydict({"text": [text] * 8}) for _ in range(12)), lookup)]
    assert sum(sizes) == 96 * -(-60_000 // 64) and max(sizes) < 2 * decontam.CHUNK


def test_decontamination_finds_halves_of_long_items(spark):
    """Items of 113 to 300 words, and texts with any half of one: the beginning, the middle, the end."""
    sizes = [113, 120, 150, 192, 200, 208, 224, 288, 289, 300]
    items = [prose(7000 + i, 400).split()[:n] for i, n in enumerate(sizes)]
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    held, texts = {}, []
    for i, x in enumerate(items):
        half = -(-len(x) // 2)
        for begin in sorted({0, (len(x) - half) // 3, (len(x) - half) // 2, len(x) - half}):
            held[len(texts)] = i
            texts.append(f"{prose(8000 + len(texts), 150)} {' '.join(x[begin : begin + half])} {prose(9000 + len(texts), 150)}")
    texts += [prose(10000 + i, 300) for i in range(50)]
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs(spark, texts), b).collect()}
    assert got == set(held.items())


def test_decontamination_edges(spark):
    d, b = docs(spark, EDGE), spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(d, b).count() == 0 and decontam.clean(d, b).count() == len(EDGE)
    b = spark.createDataFrame([(1, prose(1, 300))], "item_id long, text string")
    assert decontam.matches(d, b).count() == 0
    assert decontam.matches(d.limit(0), b).count() == 0
    assert decontam.matches(docs(spark, [prose(1, 300)]), b).first().item_id == 1


def test_lcs():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
        assert decontam.lcs(a, b) == row[-1]


# 6


CONTROL = ["</s>[INST] ok [/INST]", "<s>[ROLE]x[/ROLE]", "\\</s>", "\\\\", "[/ROLE]\\", "<<SYS>> a <</SYS>>", "plain", "", "é\n</s", "\\"]


def test_chat_round_trip(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a[/ROLE]b", None]), r.choice([*CONTROL, None])) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(100, 0, "user", "x"), (100, 0, "user", "x"), (100, 0, "assistant", "y"), (101, None, "assistant", "z"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).repartition(4)
    got = {x.conv_id: x for x in chat.read_back(chat.expand(df)).collect()}
    assert set(got) == {x[0] for x in rows}
    for c in got:
        turns = sorted(((t if t is not None else -1, ro or "", te or "") for cc, t, ro, te in rows if cc == c))
        said = "".join(te for _, ro, te in turns if ro == "assistant")
        all_ = "".join(f"{ro}\n{te}\n" for _, ro, te in turns)
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(said))
        assert got[c].turns_sha256 == hashlib.sha256(all_.encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_examples(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")], "conv_id long, turn long, role string, text string")
    made = chat.expand(df).orderBy("example").collect()
    assert [m.n_context for m in made] == [1, 3, 5]
    assert [[m.formatted[s.begin : s.end] for s in m.mask] for m in made] == [["b"], ["d"], []]
    assert made[1].formatted.startswith(made[0].formatted)
    for m in made:
        assert [(r, t) for r, t, _, _ in chat.parse(m.formatted)] == [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")][: m.n_context + (1 if m.mask else 0)]
    assert chat.expand(df.limit(0)).count() == 0


# 7


def test_language_on_the_held_out_fold(spark, sf):
    path = sf.replace("0.001", "0.01")
    d = spark.read.parquet(f"{path}/documents.parquet")
    got = {x.doc_id: x for x in langid.report(clashing(d)).collect()}
    import zlib

    truth = {x.doc_id: x.lang for x in d.collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1 for i, x in got.items())
    held = [i for i, x in got.items() if x.held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.98


def test_language_edges(spark):
    train = [prose(s, 200, ["haus", "baum", "strasse", "wagen"]) for s in range(20)]
    other = [prose(s, 200, ["casa", "arbol", "calle", "coche"]) for s in range(20)]
    d = docs(spark, train, "de").union(docs(spark, other, "es", 20)).union(docs(spark, [*EDGE, "12 34 !!"], None, 40))
    got = {x.doc_id: x for x in langid.report(d).collect()}
    assert all(got[i].lang_pred == ("de" if i < 20 else "es") for i in range(40))
    assert {i for i in got if got[i].lang_pred == "und"} == {40, 41, 42, 49} and got[40].score == 0.0
    assert {x.lang_pred for x in langid.report(docs(spark, train, None)).collect()} == {"und"}
    assert langid.report(d.limit(0)).count() == 0


def test_parse_is_the_greedy_one():
    texts = {"x": "abracadabra alakazam", "y": "hocus pocus"}
    p = langid.Parser(texts)
    t = "abracad hocusala zam"
    for k, lang in enumerate(p.langs):
        n, at = 0, 0
        while at < len(t):
            e = at + 1
            while e < len(t) and t[at : e + 1] in texts[lang]:
                e += 1
            n += 1
            at = e
        assert p.phrases([t])[0, k] == n


def greedy(text, sample):
    """Phrases of the plain parser: longest matches, one after the other."""
    n, at = 0, 0
    while at < len(text):
        e = at + 1
        while e < len(text) and text[at : e + 1] in sample:
            e += 1
        n, at = n + 1, e
    return n


def test_whole_texts_are_parsed_as_by_the_plain_parser(monkeypatch):
    r = random.Random(13)
    ideograms = "".join(chr(0x4E00 + k) for k in range(700))  # more letters than any small alphabet
    texts = {"one": prose(1, 300), "two": prose(2, 300), "many": "".join(r.choice(ideograms) for _ in range(3000)), "same": "ab" * 700}
    p = langid.Parser(texts)
    known = [prose(3, 400), prose(1, 300)[5:], texts["many"][7:2000] + prose(2, 50), "ab" * 2000, "b" + "ab" * 900 + "x", "", "q", "".join(r.choice("ab ") for _ in range(4000)), texts["many"][::-1]]
    got = p.phrases(known)
    assert got.tolist() == [[greedy(t, texts[k]) for k in p.langs] for t in known]
    monkeypatch.setattr(langid, "SEGMENT", 40)
    monkeypatch.setattr(langid, "HEAD", 3)  # hardly any segment meets its first parse in the head
    assert langid.Parser(texts).phrases(known).tolist() == got.tolist()


def test_predictions_equal_the_plain_parser_on_the_table(spark, corpus):
    texts = langid.sample(corpus, ~langid.held_out())
    codes = {k: "".join(ch if ch.isalpha() else " " for ch in t.lower()) for k, t in texts.items()}
    rows = [x for x in corpus.collect() if len(x.text) < 1500][:40]
    got = {x.doc_id: x.lang_pred for x in langid.report(corpus).collect()}
    for x in rows:
        t = "".join(ch if ch.isalpha() else " " for ch in x.text.lower())
        cost = {k: greedy(t, c) * np.log2(len(c) + 1) for k, c in codes.items()}
        want = min(sorted(cost), key=cost.get) if any(map(str.isalpha, t)) else "und"
        assert got[x.doc_id] == want


# 8


def plain_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash_equals_brute_force(spark, corpus):
    texts = {r.doc_id: r.text for r in corpus.collect()} | {10_000 + i: t for i, t in enumerate(EDGE)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("root", F.lit(2))
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.report(d).collect()}
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    lead = {i: i for i in texts}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 4 and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                lead[y] = x
    assert got == {i: (f"{fp[i]:016x}", root(i)) for i in ids}


@pytest.mark.parametrize("tile", [4096, 8])
def test_close_edges_keep_every_chain(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(5)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(4))) for b in base for _ in range(40)} | {r.getrandbits(64) for _ in range(50)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = {x.vertex & (1 << 64) - 1: x.root for x in components.components(simhash.close_edges(spark.createDataFrame(signed, "fp long"), 4)).collect()}
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 4:
                assert got[a] == got[b]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, None), (5, 4)]
    got = {x.vertex: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and got[0] != got[100] and 200 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_are_dropped_and_others_kept(spark):
    texts, r = [], random.Random(6)
    for i in range(20):
        w = prose(i, 300).split()
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            for k in r.sample(range(300), 4):  # 4 of 300 words: similarity about 0.87
                v[k] = "changed"
            texts.append(" ".join(v))
    d = docs(spark, [*texts, *EDGE])
    kept = simhash.dedup(clashing(d.union(d)))
    assert kept.columns == clashing(d).columns
    ids = [x.doc_id for x in kept.collect()]
    assert [i for i in ids if i < 80 and i % 4 == 0] and sorted(i for i in ids if i < 80) == list(range(0, 80, 4))
    assert sorted(i - 80 for i in ids if i >= 80) == [0, 3, 4, 5, 6, 7]
    assert simhash.dedup(d.limit(0)).count() == 0


def test_near_copies_at_the_threshold_are_told_by_their_shingle_sets(spark):
    texts, r, want = [], random.Random(8), []
    for i in range(150):  # pairs on both sides of 0.8: 0.70 to 0.88
        w = [f"{prose(i, 1)}{k}x{i}" for k in range(300)]
        v = list(w)
        for k in r.sample(range(300), r.randint(4, 11)):
            v[k] = "changed"
        a, b = ({tuple(x[k : k + 5]) for k in range(296)} for x in (w, v))
        texts += [" ".join(w), " ".join(v)]
        want += [2 * i] if len(a & b) / len(a | b) >= 0.8 else [2 * i, 2 * i + 1]
    assert 30 < len(want) - 150 < 120
    assert sorted(x.doc_id for x in simhash.dedup(docs(spark, texts)).collect()) == want


# 9


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers as P
    import tiktoken

    raw, pattern = bpe.load()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, corpus, encoder):
    hard = [*EDGE, "a" * 3000, " " * 4000 + "x", "\n" * 900, "中文字符" * 300, "½²³ Ⅷ x1", "a\x1cb\x85c\u00a0d", "🙂 𝒳𝒴 don't I'LL", "  two  blanks "]
    d = corpus.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")).withColumn("ids", F.lit(1))
    for r in bpe.encode(d, decoded="back").collect():
        assert r.ids == encoder.encode_ordinary(r.text or "")
        assert bytes(r.back) == (r.text or "").encode()


def test_bpe_decodes_alone(spark, encoder):
    texts = ["Hello, Welt", "", None]
    df = spark.createDataFrame([(t, encoder.encode_ordinary(t) if t is not None else None) for t in texts], "t string, ids array<int>")
    assert [x.decoded if x.t is None else bytes(x.decoded).decode() for x in bpe.decode(df).collect()] == texts
    assert bpe.encode(df.limit(0).select(F.col("t").alias("text"))).count() == 0


def test_bpe_heap_and_query_agree(encoder):
    c = bpe.Codec(*bpe.load())
    words = [w.encode() for w in (" internationalization", "aaaaaaaaaa", "ёжикёжик", "xyzxyzxyz", "=====")]
    assert c.contract(words) == c.sweep(words) == [c.contract_long(w) for w in words]


@pytest.mark.parametrize("rows", [2_000_000, 3000])
def test_bpe_sweeps_long_words_as_the_law_says(encoder, monkeypatch, rows):
    monkeypatch.setattr(bpe, "SWEEP_ROWS", rows)  # few rows: few rounds a query
    c, r = bpe.Codec(*bpe.load()), random.Random(11)
    words = ["".join(r.choice(a) for _ in range(r.randint(65, n))) for a, n in (("ab", 700), ("aaab", 900), ("abcdefghijklmnopqrstuvwxyz", 600), ("中文字符的一是了我不", 300), ("ééèê", 400), ("ACGT", 900), ("xyz", 70)) for _ in range(6)]
    words += ["a" * n for n in (65, 66, 67, 127, 1000)] + ["=" * 777, "\u0645" * 333]
    assert c.sweep([w.encode() for w in words]) == [np.array(encoder._core_bpe.encode_single_piece(w.encode()), "<u4").tobytes() for w in words]


# 10


def test_secrets_without_digits_are_found_alike():
    secret = "sk-" + "abcdefghijklmnopqrst"
    for rest in ("", " in room 7"):
        text = f"the key is {secret}{rest}"
        assert [text[a:b] for a, b, k in pii.candidates(text, pii.base_spans(text)) if k == "secret"] == [secret]


PII = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(t):
    out = []
    for k, (kind, rx) in enumerate(zip(pii.BASE, PII, strict=True)):
        for m in rx.finditer(t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_pii_base_equals_the_patterns(spark, corpus):
    r = random.Random(8)
    parts = ["a.b@c.de", "@", "x@y", "é@a.b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+123", "..", "9" * 40, " ", "\n", "a@b.c@d.e", "+1+2 3456789012"]
    made = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(300)]
    d = docs(spark, [*made, *EDGE, *[x.text for x in corpus.collect()]])
    for r_ in pii.report(clashing(d)).join(d.select("doc_id", "text"), "doc_id").collect():
        want = plain_base(r_.text or "")
        assert r_.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(r_.spans.split(","))
        assert [r_.n_email, r_.n_ip, r_.n_card, r_.n_phone] == [want.count(f"{k}:") for k in pii.BASE]


def test_pii_learns_to_accept_and_refuse(spark):
    mail, bad = "write to jane [at] example [dot] com now", "version 1.2.3 page 555-12-0000x"
    d = docs(spark, [f"{prose(i, 20)} mail me a{i}@example.com or call +1 (555) 010-{1000 + i}" for i in range(60)] + [mail] * 5 + [bad] * 5)
    got = {x.doc_id: x.spans for x in pii.report(d).collect()}
    assert got[60] == "email:9:36" and got[65] == ""
    text = {x.doc_id: x.text for x in pii.redact(clashing(d)).collect()}
    assert "@" not in text[0] and text[60] == "write to <EMAIL> now" and text[65] == bad
    assert pii.redact(clashing(d)).columns == clashing(d).columns
    assert pii.report(d.limit(0)).count() == 0 and pii.redact(docs(spark, EDGE)).count() == len(EDGE)


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries_run_on_whole_tables(spark, sf, name):
    rows = Q.queries()[name](spark, sf).count()
    whole = {"op1_media": "embeddings", "op5_decontam": None}.get(name, "documents")
    if name == "op6_chat":
        assert rows == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1
    elif whole:
        assert rows == spark.read.parquet(f"{sf}/{whole}.parquet").count()


def test_pipeline(spark, sf, corpus, encoder):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "personal_data", "tokens"] and P.ORACLE_SQL is None
    d = corpus
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, d, sf)
        assert kept.columns == corpus.columns and 0 < kept.count() <= d.count()
        d = kept
    want = {r.doc_id: encoder.encode_ordinary(r.text) for r in d.collect()}
    made = P.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in made} == want and all(r.round_trip for r in made)


def test_a_task_gives_freed_memory_back():
    """A worker lives on after its task: what the task has freed must not stay with it."""
    import subprocess
    import sys

    code = """
import pyarrow as pa
from querent.llm.common import frugal
held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
def run(batches):
    many = [bytes(60_000) for _ in range(3000)]
    pin = bytes(60_000)
    del many
    yield pin
before = held()
pins = list(frugal(run)([]))
assert held() - before < 60_000_000, held() - before
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)


def test_many_pairs_are_verified_at_once_as_one_by_one():
    """What is decided for a whole list of candidates is what consensus says of each, from either side."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((6, 64))
    vectors = [base[k % 6] + rng.standard_normal(64) * noise for k, noise in enumerate([0.0] * 6 + [0.15] * 12 + [0.4] * 12)]
    made = [media.describe(media.render(v)) for v in vectors]
    stripes = np.tile(np.repeat(np.array([40, 200], np.uint8), 6), 8)
    made += [media.describe(np.bitwise_xor.outer(stripes, stripes).astype(np.uint8)) for _ in range(2)]  # matches beyond bound
    made = [x for x in made if len(x[1]) >= media.LEAST]
    said = 0
    for a in range(len(made)):
        others = [b for b in range(len(made)) if b != a]
        got = media.agreeing(made[a], [made[b] for b in others], [a < b for b in others]).tolist()
        plain = [(media.consensus(made[a], made[b]) if a < b else media.consensus(made[b], made[a])) >= media.AGREE for b in others]
        assert got == plain
        said += sum(plain)
    assert 0 < said < len(made) * (len(made) - 1)
