"""Whitening against a solver in doubles, sharding and filter audit against brute force."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from sievework.llm import filter_audit, sharding, whitening
from sievework.llm.common import new_path

# ---- whitening


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * np.array(values, float)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [[5, 4, 3, 2, 1, 0.5], [1, 1, 1, 1 + 1e-9, 1 + 2e-9, 7], [0, 0, 0, 1, 1, 2], [1e-12, 1, 1 + 1e-14, 3, 3, 3], list(np.linspace(1, 1.0001, 40)), [2.0] * 9, [3e40, 2e40], [1e-30, 4e-30, 4e-30], [7]],
)
def test_eigenvectors_to_double_precision(values):
    a = symmetric(values)
    found, x = whitening.eigen(a)
    size, eps = max(values), np.finfo(float).eps
    assert np.abs(found - np.sort(values)[::-1]).max() < 20 * eps * size
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 8 * eps
    assert np.abs(a @ x - x * found).max() < 20 * eps * size


def test_the_sub_solves_tell_close_eigenvalues_apart():
    """A gap of 1e-9 is far below what 32 bits resolve; the vectors must still be those of the matrix."""
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(8, 8)))[0]
    values = [9, 1, 1 + 1e-9, 1 + 3e-9, 0.5, 0.5 + 1e-10, 0.1, 0]
    found, x = whitening.eigen((q * values) @ q.T)
    overlap = np.abs(x.T @ q[:, np.argsort(values)[::-1]])
    assert np.abs(overlap - np.eye(8)).max() < 1e-4  # rounding of the matrix, 1e-16, by the gap of 1e-10
    assert np.linalg.eigh(((q * values) @ q.T).astype(np.float32))[1].dtype == np.float32


def brute_whitening(vectors, components):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    z = np.array((x * n - s) / n, float)
    cov = z.T @ z / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:components], vecs[:, ::-1][:, :components]
    return n, ((x * n - s) ** 2).sum(1), z @ vecs / np.sqrt(values), values / np.trace(cov)


def vector_frame(spark, rows, id_type="long"):
    return spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], f"vec_id {id_type}, embedding array<double>, whitened string, n double")


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 5)) * [3, 2, 1, 0.7, 0.3] + 4).tolist()
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [1.0, float("nan"), 1.0, 1.0, 1.0]), (903, [1.0, float("inf"), 1.0, 1.0, 1.0]), (904, []), (905, [1.0, 2.0])]
    rows = whitening.whiten(vector_frame(spark, [*enumerate(vectors), *bad]).repartition(7), components=3).collect()
    n, deviation, want, explained = brute_whitening(vectors, 3)
    got = {(r.vec_id, r.component): r for r in rows}
    assert sorted(got) == [(i, c) for i in range(300) for c in (1, 2, 3)] and {r.n for r in rows} == {n}
    assert all(got[i, 1].deviation == deviation[i] for i in range(300))
    for c in range(3):
        w = np.array([got[i, c + 1].whitened for i in range(300)])
        assert min(np.abs(w - want[:, c]).max(), np.abs(w + want[:, c]).max()) < 1e-8
        assert got[0, c + 1].explained == pytest.approx(explained[c], rel=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and 0 <= rows[0].identity_error < 1e-9


def test_whitening_without_variance_repeats_ids_of_any_type_and_empty(spark):
    assert whitening.whiten(vector_frame(spark, [])).count() == 0
    assert whitening.whiten(vector_frame(spark, [(1, None), (2, [])])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(vector_frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    rows = [("a", [1.0, 0.0, 3.0]), ("a", [1.0, 0.0, 3.0]), (None, [2.0, 0.0, 3.0]), ("b", [4.0, 0.0, 3.0])]
    got = whitening.whiten(vector_frame(spark, rows, "string")).collect()
    assert len(got) == 12 and sum(r.vec_id is None for r in got) == 3
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert len({r.whitened for r in got if r.vec_id == "a" and r.component == 1}) == 1
    assert got[0].identity_error < 1e-9


def test_deviations_are_exact_or_an_error():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2_000_000, (50, 4))
    sums = [int(s) for s in x.sum(0)]
    want = [sum((50 * int(e) - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, 50, sums).tolist() == want
    n = 700_000_000  # as if of a far larger fit list, where the quick way no longer does
    assert whitening.deviations(np.array([[4, 1]]), n, [3 * n + 5, n]).tolist() == [(n - 5) ** 2]
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[9_000, 1]]), n, [3 * n, n])
    with pytest.raises(OverflowError):
        import pyarrow as pa

        whitening.integers(pa.array([[1e18]]), 1)


# ---- sharding


def shard_of(key, weights):
    def time(i):
        u = (int(hashlib.md5(f"{i}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / weights[i]

    return min((i for i in range(len(weights)) if weights[i] > 0), key=time)


def shard_frame(spark, rows, id_type="long"):
    return spark.createDataFrame([(i, t, 3, "clash") for i, t in rows], f"doc_id {id_type}, text string, shard int, slot string")


def test_shards_against_brute_force(spark):
    weights = [1.0, 2.0, 0.0, 0.5]
    rows = [(i, random.Random(i).choice(["", None, "é😀", "x" * 5000, f"t{i}"])) for i in range(4000)]
    got = sharding.assign(shard_frame(spark, rows).repartition(5), weights, added=1.5).collect()
    assert len(got) == 4000 and {r.law for r in got} == {"key"}
    texts = dict(rows)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.shard) == (len(raw) + 1, zlib.crc32(raw), shard_of(r.doc_id, weights))
        assert r.grown_shard == shard_of(r.doc_id, [*weights, 1.5])
    for shard in {r.shard for r in got}:
        own = sorted((r.doc_id, r.slot) for r in got if r.shard == shard)
        assert [slot for _, slot in own] == list(range(len(own)))
    share = [sum(r.shard == s for r in got) / 4000 for s in range(4)]
    assert share[2] == 0 and max(abs(a - b / 3.5) for a, b in zip(share, weights, strict=True)) < 0.03
    moved = sum(r.grown_shard != r.shard for r in got) / 4000
    assert abs(moved - 1.5 / 5) < 0.03 and all(r.grown_shard in (r.shard, 4) for r in got)


def test_a_shard_that_leaves_moves_only_its_own_keys(spark):
    docs = shard_frame(spark, [(i, "t") for i in range(1500)])
    before = {r.doc_id: r.shard for r in sharding.assign(docs, [1.0, 1.0, 1.0]).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(docs, [1.0, 0.0, 1.0]).collect()}
    assert all(after[i] == s for i, s in before.items() if s != 1) and 1 not in after.values()


def test_shards_of_null_and_repeated_ids_ties_empty_and_files(spark):
    assert sharding.assign(shard_frame(spark, []), [1.0]).count() == 0
    rows = [(None, "a"), (None, "a"), (None, None), ("k", "b"), ("k", "b"), ("k", ""), ("other", "c")] + [("hot", "same")] * 600
    docs = shard_frame(spark, rows, "string")
    got = sharding.assign(docs, [1.0] * 3, added=0).collect()
    assert len(got) == len(rows) and all(r.grown_shard == r.shard for r in got)
    for key in (None, "k", "hot"):
        assert len({r.shard for r in got if r.doc_id == key}) == 1
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    path = new_path(spark, "shards")
    sharding.write_shards(docs, path, [1.0] * 3)
    back = spark.read.parquet(path)
    assert back.groupBy("doc_id", "text", "shard_").count().select("doc_id", "shard_").distinct().count() == len({(r.doc_id, r.shard) for r in got})
    assert sorted(back.columns) == sorted([*docs.columns, "shard_"]) and back.count() == len(rows)
    with pytest.raises(ValueError):
        sharding.assign(docs, [0.0])


# ---- filters

ALPHABET = "ab AB\t\n\x0b\x0c\r #$|éß€😀　%z  "


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def odd_texts(seed=1, n=120):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([1, 3, 50, 509, 510, 511, 512, 513, 3000]))) for _ in range(n)]
    return ["", " ", "a", "x" * 3000, "é" * 1000, " ".join(["wort"] * 2000), *made]


def test_counts_against_regular_expressions(monkeypatch):
    texts = odd_texts()
    assert filter_audit.counted([t.encode() for t in texts]).tolist() == [measured(t) for t in texts]
    monkeypatch.setattr(filter_audit, "LANE", 5)
    monkeypatch.setattr(filter_audit, "COMPARED", 7)
    assert filter_audit.counted([t.encode() for t in texts[:60]]).tolist() == [measured(t) for t in texts[:60]]


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(filter_audit, "hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = odd_texts(2, 30)
    assert filter_audit.counted([t.encode() for t in texts if len(t) < 2000]).tolist() == [measured(t) for t in texts if len(t) < 2000]


def test_bytes_that_are_not_utf8_count_as_code_points():
    for raw, points, words in [(b"a\x80b", 3, 1), (b"\xff \xc3", 3, 2), (b"\xe2\x82 x", 3, 2), (b"\xf0\x9f\x98\x80\x80", 2, 1), (b"\x80\x80\x80\x80\x80\x80 ", 7, 1)]:
        assert filter_audit.counted([raw])[0][[0, 3]].tolist() == [words, points]


def test_blocks_hold_every_text_and_long_ones_alone():
    texts = [b"a" * n for n in (10, 2_000_000, 5, 0, 700_000, 700_000)]
    made = list(filter_audit.blocks(iter(texts)))
    assert sum(made, []) == texts and [len(b) for b in made] == [1, 1, 3, 1]


def brute_audit(docs, labels):
    """docs: (id, text, part), labels: (id, quality, toxic)."""
    none = lambda i: (i is None, i if i is not None else 0)
    least, rows = {}, []
    for i, t, _ in docs:
        t = t or ""
        least[t] = min(least.get(t, none(i)), none(i))
    for i, t, part in docs:
        w, d, c, n, s = measured(t or "")
        fails = {x for x, on in zip("ABCDE", [w < 200, 100 * d < 50 * w, 100 * c > 3 * n, s > 0, none(i) > least[t or ""]], strict=True) if on}
        good, toxic = (i is not None and any(q == 1 for k, q, _ in labels if k == i)), (i is not None and any(x == 1 for k, _, x in labels if k == i))
        rows.append((part or "", fails, good, toxic))
    out, orders = {}, ["".join(o) for o in permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                failing = sum(x in r[1] for r in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in orders:
            for step, x in enumerate(order, 1):
                out[part, order, step].append(shapley[x])
    return out


def audited(rows):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def filter_frames(spark, docs, labels, id_type="long"):
    d = spark.createDataFrame([(i, t, p, 1, "c", 2) for i, t, p in docs], f"doc_id {id_type}, text string, lang string, n int, digest string, fails int")
    return d, spark.createDataFrame([(i, q, x, "c") for i, q, x in labels], f"doc_id {id_type}, quality int, toxic int, lang string")


def test_audit_against_all_orders(spark):
    rng = random.Random(7)
    texts = [*odd_texts(3, 40), None, " ".join(f"w{i}" for i in range(300)), " ".join(["w", "v"] * 300), "A B " * 400]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(400)]
    docs += [(5, docs[5][1], "en")] * 2 + [(None, texts[0], "fr"), (None, texts[7], "en"), (None, "only here", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300)] + [(7, 1, 0), (7, 0, 1), (9999, 1, 1), (None, 1, 1)]
    d, marks = filter_frames(spark, docs, labels)
    got = filter_audit.audit(d.repartition(6), marks).collect()
    assert len(got) == 600 * len({p or "" for _, _, p in docs})
    assert audited(got) == brute_audit(docs, labels)


def test_audit_empty_without_labels_and_other_filters(spark):
    d, marks = filter_frames(spark, [], [])
    assert filter_audit.audit(d, marks).count() == 0
    docs = [("b", "x", "en"), ("a", "x", None), ("c", None, "en")]
    d, marks = filter_frames(spark, docs, [], "string")
    assert audited(filter_audit.audit(d, marks).collect()) == brute_audit(docs, [])
    two = filter_audit.audit(d, marks, {"S": "n_chars < 1"}, "K").where("part = 'en'").collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in two} == {("KS", 1): (1, 1, 2), ("KS", 2): (0, 1, 2), ("SK", 1): (1, 1, 2), ("SK", 2): (0, 1, 2)}
