"""Exact dedup and line dedup against brute force, with the cases their docstrings define."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sievework.llm import exact_dedup, line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], DOCS)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


ROWS = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (1, None), (3, ""), (4, "\n"), (6, " "), (7, "x" * 200_000), (8, "x" * 200_000), (10, "A b"), (11, "a b")]


def test_exact_dedup_against_brute_force(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, ROWS)).collect()}
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        group = [j for j, u in ROWS if norm(u) == norm(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(group), len(group), i == min(group))
        assert got[i].text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()


@pytest.mark.parametrize("hint", ["broadcast", "merge", "shuffle_hash"])
def test_exact_dedup_of_a_join_of_two_sources(spark, tmp_path, hint):
    docs, labels = f"{tmp_path}/docs", f"{tmp_path}/labels"
    frame(spark, ROWS).repartition(3).write.parquet(docs)
    spark.createDataFrame([(i, i % 2) for i, _ in ROWS], "doc_id long, quality int").write.parquet(labels)
    both = spark.read.parquet(docs).join(spark.read.parquet(labels).hint(hint), "doc_id")
    got = exact_dedup.exact_dedup(both)
    assert got.count() == len(ROWS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, ROWS)).collect()))
    kept = exact_dedup.stage(spark, both)
    assert kept.columns == both.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got.where("kept").collect())


def test_rows_that_are_not_found_again_are_an_error(spark, monkeypatch):
    lose = exact_dedup._compared
    monkeypatch.setattr(exact_dedup, "_compared", lambda source, hits, digest: lose(source.where("id <> 2"), hits, digest))
    with pytest.raises(RuntimeError, match="found again"):
        exact_dedup.exact_dedup(frame(spark, ROWS))


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "alone"), (3, "b"), (3, "c")]
    got = exact_dedup.exact_dedup(frame(spark, rows))
    kept = sorted((r.doc_id or 0, r.text_sha256) for r in got.where("kept").collect())
    assert got.count() == len(rows)
    assert kept == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in [(1, "a"), (0, "alone"), (3, "b"), (3, "c")])


def test_exact_dedup_large_group_and_stage(spark):
    rows = [(i, "same text") for i in range(3000)] + [(5000 + i, f"other {i}") for i in range(20)]
    docs = frame(spark, rows).repartition(5)
    got = exact_dedup.exact_dedup(docs)
    assert got.where("kept").count() == 21 and got.agg(F.max("group_size")).first()[0] == 3000
    staged = exact_dedup.stage(spark, docs)
    assert staged.columns == docs.columns and staged.count() == 21


def test_rows_that_share_a_digest_only_are_told_apart_by_their_texts(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "c"), (4, "d"), (5, "c "), (6, "a b"), (None, "c"), (7, "c"), (7, "c"), (8, "d")]
    got = exact_dedup.exact_dedup(frame(spark, rows).repartition(3), digest=lambda text: F.encode(F.lit("one"), "UTF-8")).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        group = [j for j, u in rows if norm(u) == norm(t)]
        first = min((j for j in group if j is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in got if r.doc_id == i} == {(first, len(group))}
    assert sorted(r.doc_id for r in got if r.kept) == [1, 3, 4, 5]


def test_stage_drops_repeats_with_other_white_space(spark):
    rows = [(1, "a b"), (1, "a  b"), (2, "a b"), (3, None), (4, ""), (None, "x"), (None, "x "), (5, "y"), (5, "z"), (6, "é" * 100_000)]
    docs = frame(spark, rows).withColumn("ROW_KEY", F.lit("clash")).repartition(3)
    kept = exact_dedup.stage(spark, docs)
    assert kept.columns == docs.columns
    want = [(0, "x"), (0, "x "), (1, "a b"), (3, ""), (5, "y"), (5, "z"), (6, "é" * 100_000)]
    assert sorted((r.doc_id or 0, norm(r.text)) for r in kept.collect()) == want
    assert exact_dedup.stage(spark, docs.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from sievework.llm import common

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(unset)


def test_exact_dedup_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_state_goes_on_between_runs(spark, tmp_path):
    keys = "id long, digest binary, locator string"
    src, state, log = (f"file://{tmp_path}/{x}" for x in ("src", "state", "log"))
    for rows in ([(4, b"d1", "a#4"), (9, b"d2", "a#9")], [(2, b"d1", "b#2")]):
        spark.createDataFrame(rows, keys).coalesce(1).write.mode("append").parquet(src)
        exact_dedup.digest_state(spark.readStream.schema(keys).parquet(src), state, log)
    got = {bytes(r.digest): (r.keep_id, r.locator, r.group_size) for r in exact_dedup.groups_of(spark, log, "long").collect()}
    assert got == {b"d1": (2, "b#2", 2), b"d2": (9, "a#9", 1)}


def brute_lines(rows, k=3):
    seen, gone = set(), {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        for at in range(len(lines) - k + 1):
            w = "\n".join(lines[at : at + k])
            if not w.strip(" \n\t\r"):
                continue
            if w in seen:
                gone.setdefault(i, set()).update(range(at, at + k))
            seen.add(w)
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone.get(i, ())) for i, t in rows}


def test_line_dedup_against_brute_force(spark):
    p = "one\ntwo\nthree\nfour"
    rows = [(1, p + "\nend"), (2, "start\n" + p), (3, "\n\n\n\n\n\n"), (4, None), (5, ""), (6, "one\ntwo"), (7, "a\na\na\na\na\na"), (8, "\n".join(str(i) for i in range(5000))), (9, "x\n" + "\n".join(str(i) for i in range(10, 4000)))]
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    want = brute_lines(rows)
    for i, t in rows:
        assert got[i].deduped_text == want[i] and got[i].n_lines == len((t or "").split("\n"))
        assert got[i].n_removed == got[i].n_lines - (len(want[i].split("\n")) if got[i].n_removed < got[i].n_lines else 0)


def test_line_dedup_hot_window_repeated_rows_and_empty(spark):
    rows = [(i, f"head {i}\nsame one\nsame two\nsame three\ntail {i}") for i in range(2500)]
    got = line_dedup.line_dedup(frame(spark, rows))
    assert got.where("n_removed = 3").count() == 2499 and got.where("n_removed = 0").count() == 1
    twice = line_dedup.line_dedup(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")])).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in twice) == [(1, 0), (1, 0), (99, 3)]
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_line_dedup_same_for_any_partitioning(spark, parts):
    rows = [(i, "\n".join(f"l{(i * 7 + j) % 40}" for j in range(12))) for i in range(60)]
    got = {r.doc_id: r.deduped_text for r in line_dedup.line_dedup(frame(spark, rows).repartition(parts)).collect()}
    assert got == brute_lines(rows)
