"""BPE, token counts, fingerprints, quality and language-model scores against brute force."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sievework.llm import bpe, lz_fingerprint, quality, unigram_counts, wordblocks

DOCS = "doc_id long, text string, score string, n_tokens string"
TEXTS = [
    None, "", " ", "\n\n\n  x", "Hello world's  end\t\ttabs", "a\x00b\x01c", "naïve café ÉÉ 日本語テキスト", "🎉🎉 emoji‍", "1234567 89", "'s 're it's", "x" * 30_000, "ab " * 20_000, "\x85 wide",
    "don't stop  \n now", "<|endoftext|>", "͸unassigned",
]
WORDS = ["the", "of", "running", "tokens", "Ünïcode", "zq", "again,", "end."]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.3 else "") for _ in range(rng.randrange(0, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_as_tiktoken_and_round_trip(spark, ranks):
    rows = list(enumerate(TEXTS + random_texts(40)))
    rows += [(3, TEXTS[3]), (None, "no id")]
    encoded = bpe.encode(frame(spark, rows).repartition(3), ranks, public_tokenizers.PATTERN)
    got = bpe.decode(encoded, ranks).collect()
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i if i is not None else -1, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    digest = {r.doc_id: r for r in bpe.digests(bpe.decode(encoded, ranks)).collect()}
    assert digest[4].decoded_sha256 == hashlib.sha256(TEXTS[4].encode()).hexdigest()


def test_merging_as_tiktoken(ranks):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    words = [w for t in TEXTS + random_texts(20) for w in bpe._cutter(public_tokenizers.PATTERN)(t or "")]
    words += ["".join(rng.choice("aábcdeßtionrs 日本") for _ in range(rng.randrange(1, 90))) for _ in range(400)] + ["ab" * 16, "a" * 31, "a" * 32, "a" * 33]
    for w in words:
        assert bpe.merged(w.encode(), ranks) == enc._core_bpe.encode_single_piece(w.encode())


def test_blocks_equal_plain_rows(spark, ranks):
    rows = list(enumerate(TEXTS[:10] + TEXTS[12:] + random_texts(20))) + [(3, TEXTS[3]), (None, "no id")]
    docs = frame(spark, rows).repartition(3)
    plain = bpe.decode_rows(bpe.encode_rows(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    blocks = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert [(r.doc_id, np.array(r.ids, "<u4").tobytes(), bytes(r.decoded)) for r in sorted(plain, key=key)] == [(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in sorted(blocks, key=key)]


def test_one_python_worker_a_task_puts_ids_together_and_decodes_them(spark, ranks, monkeypatch):
    import __spark_entry__
    import corpus_pipeline

    docs = frame(spark, enumerate(TEXTS + random_texts(20))).repartition(2)
    apart = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan(apart)
    stage = corpus_pipeline.encode(spark, docs, "")
    for df in (stage, __spark_entry__.queries()["op6_byte_bpe"](spark, "/root/testdata/sf0.001")):
        assert "FlatMapCoGroupsInPandas" in plan(df) and "MapInArrow" not in plan(df)
    assert sorted(map(tuple, stage.collect())) == sorted(map(tuple, bpe.digests(apart).collect()))
    monkeypatch.setattr(bpe, "decode", None)
    got = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apart.collect())) and got.columns == apart.columns
    assert bpe.round_trip(frame(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_empty_table(spark, ranks):
    assert bpe.decode(bpe.encode(frame(spark, []), ranks, public_tokenizers.PATTERN), ranks).count() == 0


def best_path(word, scores, longest, floor):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + floor * n, -(best[end - 1][1] + n))]
        options += [(best[s][0] + scores[word[s:end]], -(best[s][1] + 1)) for s in range(max(0, end - longest), end) if word[s:end] in scores]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts_against_direct_programming(spark):
    scores = unigram_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    hot = [" ".join("http" + "".join(rng.choice("abcd./") for _ in range(rng.randrange(1, 90))) for _ in range(150)) for _ in range(6)]
    rows = list(enumerate(TEXTS + random_texts(30) + hot + ["".join(rng.choice("thesingand") for _ in range(20_000))]))
    found = unigram_counts.token_counts(frame(spark, [*rows, rows[5], (None, "no id")]), scores).collect()
    assert len(found) == len(rows) + 2
    got = {r.doc_id: r for r in found}
    longest, floor = max(map(len, scores)), min(scores.values()) - 1
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        assert got[i].n_words == len(words)
        assert got[i].n_tokens == sum(best_path("▁" + w, scores, longest, floor) for w in words)
    assert unigram_counts.token_counts(frame(spark, []), scores).count() == 0


def test_words_that_begin_alike_are_dealt_by_longer_beginnings():
    rng = random.Random(1)
    words = list({"▁http" + "".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(3000)}) + ["▁http", "▁h", "▁the"] + [f"▁w{i}" for i in range(500)]
    buckets = wordblocks.dealt_buckets(words, 5, 32)
    assert np.bincount(buckets, minlength=32).max() < 3 * len(words) / 32
    again = wordblocks.dealt_buckets(words[::-1], 5, 32)
    assert np.array_equal(buckets, again[::-1])


def test_a_long_word_adds_few_nodes():
    trie = unigram_counts.Trie({"a": -1.0, "aa": -1.5, "ab": -1.2})
    assert trie.count("ab" * 5000 + "a") == 5001
    node, depth = trie.root, 0
    while node[2]:
        node, depth = next(iter(node[2].values())), depth + 1
    assert depth == unigram_counts.DEPTH


def phrases(text):
    known, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in known:
            known.add(text[start:end])
            start = end
    return known


def test_phrases_are_those_of_a_plain_parse():
    for t in [*filter(None, TEXTS[:14]), *random_texts(5, 3)]:
        p = lz_fingerprint.Phrases().read(lz_fingerprint.code_points(t))
        assert len(p.hashes) - 1 == len(phrases(t)) == len(set(p.hashes[1:]))
        cut = len(t) // 3
        again = lz_fingerprint.Phrases().read(lz_fingerprint.code_points(t[:cut])).copy().read(lz_fingerprint.code_points(t[cut:]))
        assert again.hashes == p.hashes


def test_likeness_estimates_jaccard():
    a, b = random_texts(2, 9)[0] * 9, random_texts(2, 8)[1] * 9
    print_ = lambda t: lz_fingerprint.Phrases().read(lz_fingerprint.code_points(t)).fingerprint()
    truth = len(phrases(a) & phrases(b)) / len(phrases(a) | phrases(b))
    assert abs(lz_fingerprint.likeness(print_(a), print_(b)) - truth) < 0.2
    assert lz_fingerprint.likeness(print_(a), print_(a)) == 1.0
    assert lz_fingerprint.likeness(print_(""), print_("")) == 1.0 and lz_fingerprint.likeness(print_(""), print_(a)) == 0.0


def plain_print(text):
    """The fingerprint written out once more: a phrase's hash goes on from that of the phrase it extends."""
    of = {"": 1}
    for phrase in sorted(phrases(text), key=len):
        of[phrase] = (of[phrase[:-1]] * 6364136223846793005 + ord(phrase[-1]) + 1) % 2**64
    mixed = set()
    for phrase, h in of.items():
        if phrase:
            h ^= h >> 30
            h = h * 0xBF58476D1CE4E5B9 % 2**64
            h ^= h >> 27
            h = h * 0x94D049BB133111EB % 2**64
            mixed.add(h >> 32)
    return sorted(mixed)[:128]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    k = 128 if max(len(a), len(b)) >= 128 else len(a) + len(b)
    smallest = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in smallest) / len(smallest)


def brute_prints(rows):
    import base64
    import struct

    import xxhash

    order = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), seed=42)) >> 1
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else rows[0][0], order(r[1])), reverse=True)
    out = []
    text = lambda p: base64.b64encode(struct.pack(f"<{len(p)}I", *p)).decode()
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, e, n = map(plain_print, (t, edited, nxt))
        out.append((i, len(t), edited, text(a), text(e), plain_likeness(a, e), plain_likeness(a, n)))
    return out


def same_prints(got, rows):
    key = lambda r: (r[0] is None, r[0] or type(rows[0][0])(), r[2], r[4])
    return sorted(map(tuple, got), key=key) == sorted(brute_prints(rows), key=key)


@pytest.mark.parametrize("n", [1, 2, 9, 60])
def test_fingerprints_against_brute_force(spark, n):
    rows = list(enumerate((TEXTS[:10] + TEXTS[12:] + random_texts(60))[:n]))
    if n > 20:
        rows += [(7, "repeated id"), (None, "null id"), rows[4]]
    assert same_prints(lz_fingerprint.fingerprints(frame(spark, rows).repartition(3)).collect(), rows)


@pytest.mark.parametrize("ids", ["large", "text", "hot", "hot null"])
def test_fingerprints_of_any_ids(spark, ids):
    """Ids that no double tells apart, strings, and ids that most of the rows share."""
    of = {"large": lambda i: 2**60 + i * 37 % 50 * 100, "text": lambda i: f"dé{i * 7 % 50}", "hot": lambda i: 5 if i % 5 else i, "hot null": lambda i: None if i % 4 == 1 else i}[ids]
    rows = [(of(i), t) for i, t in enumerate(random_texts(50, 5))]
    docs = spark.createDataFrame(rows, f"doc_id {'string' if ids == 'text' else 'long'}, text string").repartition(5)
    dealt = lz_fingerprint.neighbours(docs, "doc_id", "text")
    assert dealt.where("extra = 0").count() == 50
    assert dealt.where("extra = 0").select("part").distinct().count() > 2
    assert same_prints(lz_fingerprint.fingerprints(docs).collect(), rows)


@pytest.mark.parametrize("ids", ["doc-{:09d}", "https://example.org/pages/{:05d}/index.html"])
def test_ids_that_begin_alike_are_dealt_evenly(spark, ids):
    """One id far below and one far above the rest change nothing."""
    rows = [("a", "low"), ("zz", "high"), *((ids.format(i), f"text {i} of them") for i in range(600))]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    sizes = [r["count"] for r in lz_fingerprint.neighbours(docs, "doc_id", "text").where("extra = 0").groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.7 * 602 / 4
    few = rows[:40]
    assert same_prints(lz_fingerprint.fingerprints(spark.createDataFrame(few, "doc_id string, text string").repartition(3)).collect(), few)


def test_fingerprints_refuse_other_ids(spark):
    with pytest.raises(TypeError):
        lz_fingerprint.fingerprints(spark.createDataFrame([(True, "a")], "doc_id boolean, text string"))


def test_fingerprints_empty_table(spark):
    assert lz_fingerprint.fingerprints(frame(spark, [])).count() == 0


def test_quality_learns_and_defines_edges(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(80)) + "." for _ in range(120)]
    bad = [("SPAM!! " * rng.randrange(20, 90)) for _ in range(60)] + [" ".join(rng.choice(WORDS) + "***" for _ in range(60)) for _ in range(60)]
    rows = list(enumerate(good + bad)) + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(3, 1, 0), (9999, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in quality.classify(docs.select("doc_id", "text"), labels).withColumn("held_out", quality.held_out()).collect()}
    held = [i for i in range(240) if got[i].held_out]
    assert len(held) > 20 and sum(got[i].predicted == int(i < 120) for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[1000].score == got[1001].score
    none = quality.classify(docs.select("doc_id", "text"), labels.where("doc_id < 0")).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in none)
    kept = quality.stage(docs, labels)
    assert kept.columns == docs.columns
    assert quality.classify(docs.limit(0), labels).count() == 0
    # clashing names in any case, ids as text, and two texts of one id, in any order of rows
    clash = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("Predicted"), F.lit(2).alias("QUALITY_SCORE"))
    more = clash.unionByName(clash.where("doc_id IN ('7', '8')").withColumn("text", F.lit("another text")))
    ways = [{(r.doc_id, round(r.score, 9)) for r in quality.classify(more.repartition(n, "text"), labels.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()} for n in (1, 5)]
    assert ways[0] == ways[1] and len(ways[0]) == len(rows) + 2
    assert quality.stage(clash, labels.withColumn("doc_id", F.col("doc_id").cast("string"))).columns == clash.columns


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data here")
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality.classify(docs, labels).where(quality.held_out()).join(labels.where("quality IS NOT NULL").select("doc_id", "quality"), "doc_id").collect()
    assert len(held) > 40 and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    above = [a.score > b.score for a in held for b in held if a.quality == 1 and b.quality == 0]
    assert sum(above) >= 0.98 * len(above)
