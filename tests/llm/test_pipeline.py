"""The pipeline's stages on awkward documents and against what they promise."""

import hashlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from tidewheel.llm import mixing


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append(docs)
    return out


def test_columns_and_rows(spark, sf_dir, kept):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in kept[:4]:
        assert df.columns == before.columns
    n = [before.count(), *(df.count() for df in kept[:4])]
    assert n[0] > n[1] >= n[2] > n[3] == n[4]


def test_toxic_documents_go_and_others_stay(spark, sf_dir, kept):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stay = {r.doc_id for r in kept[0].select("doc_id").collect()}
    wrong = sum((i in stay) == bool(t) for i, t in labels.items())
    assert wrong <= 0.06 * len(labels)


def test_one_of_each_group_of_copies(kept):
    groups = defaultdict(list)
    for r in kept[1].collect():
        groups[r.text].append(r.doc_id)
    stay = {r.doc_id for r in kept[2].select("doc_id").collect()}
    for ids in groups.values():
        assert len(stay & set(ids)) <= 1


def test_sequences_hold_all_documents(kept):
    have = defaultdict(int)
    total = {}
    for r in kept[4].collect():
        have[r.doc_id] += r.length
        total[r.doc_id] = r.doc_tokens
    assert have == total and set(have) == {r.doc_id for r in kept[3].select("doc_id").collect()}


def test_stages_take_awkward_documents(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c", None, "s", 5), (None, "words without an id", "en", "s", 19)]
    for n in (0, len(rows)):
        docs = spark.createDataFrame(rows[:n], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        for name, stage in P.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() >= bool(n)


@pytest.mark.parametrize("labels", [[], [(1, None), (2, None)], [(None, 1)], [(10, 1), (20, 0)], [(i, 1) for i in range(5)]])
def test_without_usable_labels_all_documents_stay(spark, tmp_path, labels):
    rows = [(i, f"words of document {i}", "en", "s", 1) for i in range(5)] + [(7, None, "en", "s", 0), (8, "", "en", "s", 0), (10, " ", "en", "s", 1), (20, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(map(str, P.drop_toxic(spark, docs, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_sequences_follow_the_schedule_over_several_files(spark, tmp_path):
    rows = [(i, f"word{i} " * (40 + i * 37 % 400), "en", "abc"[i % 7 % 3], 1) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    slot = {r.doc_id: (r.slot, hashlib.md5(str(r.doc_id).encode()).hexdigest()) for r in mixing.mix(docs).select("doc_id", "slot").collect()}
    mixed = P.mix_sources(spark, docs, "").collect()
    for k, part in enumerate((mixed[:100], mixed[100:150], mixed[150:700], mixed[700:])):  # files of several sizes
        spark.createDataFrame(part, docs.schema).coalesce(1).write.parquet(f"{tmp_path}/d", mode="append" if k else "error")
    got = P.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()
    for bucket in {r.bucket for r in got}:
        seen = [slot[r.doc_id] for r in sorted((r for r in got if r.bucket == bucket), key=lambda r: r.sequence_id)]
        assert seen == sorted(seen)
