"""Similarity join, mixing and WARC against brute force; the pipeline against its parts."""

import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.llm import jaccard, mixing, warc
from sievework.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in rows], DOCS)


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(rows, threshold=0.8):
    sets = {i: grams(t) for i, t in rows}
    words = {i: tuple((t or "").lower().split()) for i, t in rows}
    near = lambda a, b: words[a] == words[b] or bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9
    ids = sorted(sets)
    links = {a: [b for b in ids if b != a and near(a, b)] for a in ids}
    label = {}
    for a in ids:
        if a in label:
            continue
        stack = [a]
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = a
                stack += links[x]
    return {a: (label[a], sum(v == label[a] for v in label.values()), min(b for b in ids if words[b] == words[a]), len(links[a])) for a in ids}


def similar_rows(seed, n_groups=8, copies=6):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(n_groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 150))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((at, (" " if rng.random() < 0.5 else "\n").join(w)))
            at += 1
    return rows + [(at, None), (at + 1, ""), (at + 2, "  "), (at + 3, "short one"), (at + 4, "Short  ONE"), (at + 5, "long " * 30_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_against_all_pairs(spark, seed):
    rows = similar_rows(seed)
    got = jaccard.similar(frame(spark, [(i, t, "s") for i, t in rows]).repartition(5)).collect()
    assert {r.doc_id: (r.class_id, r.class_size, r.copy_of, r.n_links) for r in got} == brute_classes(rows)


def test_similar_large_group_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, rows[0][1]) for i in range(40)]
    got = jaccard.similar(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    assert {r.doc_id: (r.class_id, r.class_size, r.copy_of, r.n_links) for r in got} == brute_classes(rows)


def test_a_chain_of_unlike_candidates_is_not_compared_as_one(spark, monkeypatch):
    """Each text shares under half of its n-grams with the next one: candidates meet, but no group grows along the chain."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**9)}" for _ in range(60 * 400 + 200)]
    rows = [(i, " ".join(words[i * 60 : i * 60 + 190])) for i in range(400)]
    rows += [(1000 + i, rows[i * 20][1] + " more") for i in range(20)]
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    asked, made = [], jaccard.comparisons
    monkeypatch.setattr(jaccard, "comparisons", lambda met, n_grams: asked.append(out := made(met, n_grams)) or out)
    got = jaccard.similar(docs).collect()
    assert {r.doc_id: (r.class_id, r.class_size, r.copy_of, r.n_links) for r in got} == brute_classes(rows)
    met = asked[0].count()
    sent = asked[0].select(F.explode("work").alias("w")).agg(F.sum("w.blocks")).first()[0]
    assert met > 150 and asked[0].groupBy("label").count().agg(F.max("count")).first()[0] < 30
    assert sent < 12 * met  # all pairs of one group of that size would send every text to each of its blocks
    assert len(rows) / 8 > 12


def test_similar_empty_null_ids_repeats_and_stage(spark):
    assert jaccard.similar(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(2, text, "s"), (2, text, "s"), (1, text + " more", "s"), (None, text, "s"), (3, "quite another text of seven words here", "s")])
    got = {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in jaccard.similar(docs).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 0)}
    kept = jaccard.stage(spark, docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, 100_000 + i) for i in range(200)] + [(i + 1, 100_000 + i) for i in range(200)] + [(1000 + i, 7) for i in range(3000)]
    got = dict(map(tuple, jaccard.components(spark.createDataFrame(edges, "node long, bucket long")).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(3000)} == {1000}


def mixed(spark, rows):
    return mixing.mix(frame(spark, rows).repartition(3)).collect()


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", "B", "é", None])) for i in range(900)] + [(2000, None, "a"), (2001, "w " * 3000, "b"), (5, "twin", "zz"), (5, "twin", "zz")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    names = sorted({r.source for r in got if r.source is not None}) + [None]
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * size[s]}
        if not above:
            break
        for s in above:
            want[s] = 2 * size[s]
            left -= want[s]
        free -= above
    want |= {s: level * weight[s] for s in free}
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1
    again = sorted((r.doc_id, r.size, r.taken) for r in mixed(spark, rows))
    assert again == sorted((r.doc_id, r.size, r.taken) for r in got)


def test_mixing_edges_and_stage(spark):
    assert mixed(spark, []) == []
    assert [(r.size, r.taken) for r in mixed(spark, [(1, None, "a"), (2, " \n", None)])] == [(0, 0), (0, 0)]
    docs = frame(spark, [(i, "one two three", "a" if i % 2 else "b") for i in range(40)])
    out = mixing.stage(spark, docs)
    assert out.columns == docs.columns and 50 <= out.count() <= 70
    # nulls in every column, repeats, clashing names
    odd = frame(spark, [(None, None, None), (1, None, "a"), (1, None, "a"), (2, "w " * 5000, "a"), (2, "w " * 5000, "a"), (None, "x y", None)]).withColumn("MIX_SLOT", F.lit(1))
    out = mixing.stage(spark, odd)
    assert out.columns == odd.columns and out.where("text IS NULL").count() == 3
    assert mixing.stage(spark, odd.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["same", "other"])
def test_mixing_of_rows_without_ids_or_with_one_id(spark, monkeypatch, text):
    """They are numbered in many ranges, not in one, and the mix is as exact as with ids."""
    rows = [(None if i % 3 else 7, "one text of five words" if text == "same" else f"text {i} of " + "w " * (i % 9), "ab"[i % 2]) for i in range(3000)]
    orders, real = [], mixing.running
    monkeypatch.setattr(mixing, "running", lambda df, order, sums, name: orders.append((name, df, order)) or real(df, order, sums, name))
    got = mixing.mix(frame(spark, rows).repartition(4)).collect()
    size = {s: sum(len(t.split()) for _, t, q in rows if q == s) for s in "ab"}
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and own[0].source_size == size[s] and all(r.taken <= 2 * r.size for r in own)
    df, order = next((d, o) for n, d, o in orders if n == "in-order")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in df.repartitionByRange(*order).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 1.5 * 3000 / 4


def test_schedule_is_of_low_discrepancy(spark):
    sources = spark.createDataFrame([(0, 25_000), (1, 10_000), (2, 5_000)], "ordinal int, needs long")
    slots = mixing.schedule(sources, 40_000).collect()
    assert len(slots) == 40_000
    for share, o in ((5 / 8, 0), (2 / 8, 1), (1 / 8, 2)):
        own = sorted((r.slot, r["rank"]) for r in slots if r.ordinal == o)
        assert [k for _, k in own] == list(range(len(own)))
        assert all(abs((k + 1) - share * (s + 1)) < 8 for s, k in own)


def test_schedule_of_many_sources(spark):
    needs = [1 + (i * i) % 7 for i in range(3000)] + [40_000]
    slots = mixing.schedule(spark.createDataFrame(list(enumerate(needs)), "ordinal long, needs long"), sum(needs)).collect()
    edges = [0]
    for n in needs:
        edges.append(edges[-1] + n)
    assert sorted(r.slot for r in slots) == list(range(sum(needs)))
    for r in slots:
        point = r.slot * mixing.GOLDEN % 2**32 / 2**32
        assert edges[r.ordinal] / edges[-1] <= point < edges[r.ordinal + 1] / edges[-1]


def test_the_mix_comes_through_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rng = random.Random(8)
    rows = [(i, f"d{i} " + "w " * rng.randrange(0, 30), rng.choice(["a", "b", "b", "c"])) for i in range(600)]
    docs = frame(spark, rows)
    taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
    out = [(r.doc_id, r.source) for r in mixing.stage(spark, docs).collect()]
    # copies stand in the order of their slots, and every source has its share of every tenth of them
    at = {i: list(r.slots) for i, r in taken.items()}
    slots = [at[i].pop(0) for i, _ in out]
    assert slots == sorted(slots)
    words = {s: sum(r.taken for r in taken.values() if r.source == s) for s in "abc"}
    top = max(s for r in taken.values() for s in r.slots) + 1
    planned, _ = mixing.plan(spark.createDataFrame([(0, sum(r.size for r in taken.values() if r.source == "a"), words["a"])], "ordinal long, source_size long, goal long"))
    assert planned.agg(F.sum("words")).first()[0] == words["a"]
    for k in range(10):
        part = [i for i, s in zip(out, slots, strict=True) if k * top / 10 <= s < (k + 1) * top / 10]
        for s in "abc":
            share = sum(taken[i].size for i, own in part if own == s) / max(1, sum(taken[i].size for i, _ in part))
            assert abs(share - words[s] / sum(words.values())) < 0.12
    # without its schedule there is no mix
    monkeypatch.setattr(mixing, "schedule", lambda sources, slots: spark.createDataFrame([], "ordinal long, slot long, rank long"))
    with pytest.raises(RuntimeError, match="slots"):
        mixing.mix(docs)


PAGES = "page_id long, url string, html string, offset string"


def test_warc_round_trip_and_revisits(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nb", "x" * 300_000, "<p>a</p>", "x" * 300_000]
    rows = [(i, None if i == 3 else f"http://h/{i}\nx", h, "clash") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    index = warc.write(pages, new_path(spark, "t"))
    got = {r.page_id: r for r in warc.read(index).collect()}
    for i, h in enumerate(html):
        h = h or ""
        top = max(j for j, g in enumerate(html) if (g or "") == h)
        assert got[i].record_type == ("response" if i == top else "revisit") and got[i].refers_to == (None if i == top else top)
        assert got[i].payload_bytes == len(h.encode()) and got[i].payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert got[i].html == (h if i == top else None)
    some = warc.read(index.where("page_id IN (1, 4)")).collect()
    assert sorted(r.page_id for r in some) == [1, 4]
    first = index.orderBy("archive", "offset").first()
    raw = open(first.archive.removeprefix("file://"), "rb").read()
    assert gzip.decompress(raw[first.offset : first.offset + first.length]).startswith(b"WARC/1.1\r\n")
    small = warc.round_trip(pages, min_bytes=9)
    assert {r.page_id for r in small.where("record_type = 'revisit'").collect()} == {5}


def test_warc_repeats_null_ids_hot_payload_and_empty(spark):
    rows = [(i, f"u{i}", "same", "c") for i in range(1500)] + [(1499, "u", "same", "c"), (None, "n", "same", "c"), (None, "n", "alone", "c")]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    assert sum(r.record_type == "response" for r in got) == 3
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_every_stage_takes_odd_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, ties, clashing names, and no rows at all."""
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long, score double, Predicted int, quality_score int, row_key string, MIX_KEY string, size long, node long, id long"
    odd = [(None, None, None, None), (1, "", "en", "a"), (2, "a b c d e f", None, "a"), (2, "a  b c d e f", "en", None), (3, "x" * 50_000, "en", "b"), (None, "no id", "en", "a"), (4, "w " * 20_000, "en", "b"), (4, "w " * 20_000, "en", "b"), (5, "\u2028 é 🎉", "en", "a")]
    docs = spark.createDataFrame([(*r, None, 1.0, 2, 3, "k", "m", 4, 5, 6) for r in odd], names)
    spark.createDataFrame([(2, 1, 0), (3, 0, None), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, f"file://{tmp_path}")
            assert name == "byte-level BPE" or out.columns == rows.columns
            assert out.count() == 0 if rows is not docs else out.count() > 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from sievework.llm import bpe, quality

    rng = random.Random(6)
    good = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(150)]
    rows = [(i, t, f"src{i % 3}") for i, t in enumerate(good)]
    rows += [(200 + i, good[i], "src0") for i in range(20)] + [(300 + i, good[i] + " tail", "src1") for i in range(20, 30)] + [(400 + i, "BUY NOW!! " * 40, "src2") for i in range(40)]
    docs = frame(spark, rows).drop("label", "bucket")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    kept = {r.doc_id for r in quality.stage(docs, labels).collect()}
    assert all(i in kept for i, _, _ in rows if i < 400) and not any(i >= 400 for i in kept)
    left, seen = [], set()
    for i, t, s in sorted(rows):
        if i in kept and t not in seen:
            seen.add(t)
            left.append((i, t, s))
    classes = brute_classes([(i, t) for i, t, _ in left])
    left = [r for r in left if classes[r[0]][0] == r[0]]
    mix = {r.doc_id: round(r.taken / r.size) for r in mixed(spark, left)}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, len(enc.encode_ordinary(t))) for i, t, _ in left for _ in range(mix[i]))
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want
