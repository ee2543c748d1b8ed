"""Operators against brute force on small tables, and the awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import check
from tidewheel.llm import embed_dedup, induced, line_dedup, mixing, packing, quality, queries, shards, simhash, suffix_dedup, topk, toxicity, url_filter

D = "doc_id bigint, text string, source string, bucket int, score double, n_lines string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(5)
    long = text(rng, 20000)
    base = text(rng, 60)
    rows = [
        (1, base, "a"), (2, base, "a"), (3, base + " more", "b"), (4, None, "a"), (5, "", None), (6, "   ", "a"), (7, long, "c"), (8, "short", "a"), (None, "no id here at all", "a"), (None, None, None),
        (9, "tie tie tie tie tie tie", "b"), (9, "tie tie tie tie tie tie", "b"), (10, "\n\n", "b"), (11, "x" * 3000, "b"), (12, "日本 語 の 文 é ü\nzwei\tdrei", "c"), (13, "a \n b  c", "c"),
    ]
    rows += [(20 + i, f"Licence number {i} of the common kind applies here\n{text(rng, 30)}", "a") for i in range(6)]
    return spark.createDataFrame([(*r, 1, 0.5, "z") for r in rows], D)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


LABELS = "doc_id bigint, quality int, toxic int, text string"


def labelled(spark, n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        bad, low = i % 4 == 0, i % 5 == 1
        words = text(rng, 25).split()
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grumblefoo", "snarkbits", "grumblefoos!"])
        body = " ".join(words)
        docs.append((i, body.upper() + "!!" if low else body, "s", 1, 0.0, "z"))
        labels.append((i, int(not low), int(bad), "t"))
    return spark.createDataFrame(docs, D), spark.createDataFrame([*labels, (None, 1, 1, "t"), (7, None, None, "t")], LABELS)


def own(df):
    return df.drop("bucket", "score", "n_lines")


# 1: packing


def test_packing_round_trip(spark, awkward):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = [(50 + i, t, "a", 1, 0.5, "z") for i, t in enumerate(["one<|endoftext|>two three", "a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|><|endoftext|>\n  y"])]
    awkward = awkward.unionByName(spark.createDataFrame(special, D))
    rows = packing.pack(awkward, with_ids=True, **queries._tokenizer()).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    pieces = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 1024 and 2**r.bucket == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id, r.doc_tokens].append(r)
    for doc_id, body in {(r.doc_id, r.text) for r in awkward.collect()}:
        want = [*tokenizer.encode(body or "", add_special_tokens=False).ids, 0]
        got = sorted(pieces[doc_id, len(want)], key=lambda r: r.start)
        if doc_id == 9:  # a repeated row: two documents
            got = [r for i, r in enumerate(got) if i % 2 == 0]
        assert sum((r.ids for r in got), []) == want and [r.start for r in got] == [sum(x.length for x in got[:i]) for i in range(len(got))]


def test_packing_lengths_and_empty(spark, empty):
    for n in (0, 1, 7, 1023, 1024, 1025, 5000):
        assert packing.lengths(n, 1024).sum() == n and all(x & (x - 1) == 0 for x in packing.lengths(n, 1024).tolist())
    assert packing.pack(empty, **queries._tokenizer()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, "x", longest=1000)


@pytest.mark.parametrize("ranks", [True, False])
def test_tokenizer_equals_the_library(ranks):
    kinds = queries._tokenizer()
    own_, rng = packing.Tokenizer(kinds["tokenizer"], kinds["ranks"] if ranks else None), random.Random(3)
    signs = ["a", "bc", " ", "  ", "\n", "\t", "é", "ß", "日本", "\U0001f600", "'s", "12", "!", "<|endoftext|>", "\u3000", "I'll"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", " "]
    library = Tokenizer.from_file(kinds["tokenizer"])
    for t, got in zip(texts, own_.encode(texts)):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids, t


# 2 and 5: classifiers


def test_tokenizer_on_long_runs_and_latin_letters():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, library, rng = packing.Tokenizer(path, (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)), Tokenizer.from_file(path), random.Random(8)
    texts = ["".join(chr(rng.randrange(0x250)) for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += ["".join(rng.choice(" \t\n\x85\xa0\x1c9é.'s²½") for _ in range(rng.randrange(40))) for _ in range(600)]
    texts += [" " * 1_500_000, "a b" + "\t" * 1_500_000 + "c d", "a" * 300_000, "ends <|endoftext|> here", "один two"]
    assert [x.tolist() for x in ours.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    got = toxicity.classify(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and len(held) > 40 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_in_letters_that_are_not_latin():
    rng = random.Random(1)
    for alphabet, insults in (("абвгдежзийклмнопрстуфхцчшщыэюя", ["гадоптица", "сквернож"]), ("αβγδεζηθικλμνξοπρστυφχψω", ["κακοπουλο", "βρωμικος"]), ("अआइईउऊकखगघचछजझटठडढणतथदधनपफबभमयरलवशसह", ["गधाबकवास", "मूरखआदमी"])):
        words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 10))) for _ in range(300)]
        texts, toxic = [], np.array([i % 3 == 0 for i in range(600)], dtype=np.int64)
        for bad in toxic.tolist():
            body = [rng.choice(words) for _ in range(25)]
            if bad:
                x = rng.choice(insults)
                k = rng.randrange(1, len(x))
                body[rng.randrange(25)] = rng.choice([x, f"{x[:k]}-{x[k:]}", x.upper(), " ".join(x)])
            texts.append(" ".join(body))
        score, held = toxicity.fit(texts[:400], toxic[:400]).score(texts[400:]), toxic[400:]
        above = score[held == 1][:, None] - score[held == 0][None, :]
        assert (above > 0).mean() + 0.5 * (above == 0).mean() >= 0.95


def test_toxicity_tolerates_inserted_signs(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    plain, bent = "alpha1 beta2 gamma3", "alpha1 beta2 {} gamma3"
    low = model.score([plain, "", None])
    for word in ("grumblefoo", "grum-blefoo", "g.r.u.m.b.l.e.f.o.o", "g r u m b l e f o o", "SNARKBITS!"):
        assert model.score([bent.format(word)])[0] > 0.5 > low.max()


def test_string_kernel_by_definition():
    words = ["grumble", "gr-umble", "stumble", "a", "aaaaaa"]

    def explicit(w):
        s = [27, *(c for c in toxicity._classes(np.array([ord(x) for x in w])).tolist() if c != toxicity.SIGN), 28]
        out = defaultdict(float)
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + 5)):
                    out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i - 2)
        n = sum(v * v for v in out.values()) ** 0.5
        return {k: v / n for k, v in out.items()}

    got = toxicity.kernel(words, toxicity.columns(words))
    for a, x in enumerate(words):
        for b, y in enumerate(words):
            want = sum(v * explicit(y).get(k, 0) for k, v in explicit(x).items())
            assert abs(got[a, b] - want) < 1e-5


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    got = quality.classify(docs, labels, rows=300).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_quality_votes_equal_plain_ones():
    rng = random.Random(7)
    texts = [text(rng, rng.randrange(1, 40)) for _ in range(80)]
    texts += texts[:30]  # ties: equal texts with other labels
    both = [quality.counts(t) for t in texts]
    terms, form = (np.stack([b[k] for b in both]) for k in (0, 1))
    labels = np.array([rng.randrange(2) for _ in texts])
    model = quality.Model(terms, form, labels)
    asked = model.latent(terms[:60], form[:60])
    for v, got in zip(asked, model.score(asked)):
        near = [round(sum(float(a) * float(b) for a, b in zip(v, w)), 9) for w in model.vectors]
        order = sorted(range(len(near)), key=lambda i: (-near[i], i))[: quality.NEIGHBOURS]
        weight = [max(near[i], 1e-6) ** 8 for i in order]
        assert abs(got - sum(w * labels[i] for w, i in zip(weight, order)) / sum(weight)) < 1e-6


@pytest.mark.parametrize("op", [toxicity, quality])
def test_classifiers_on_awkward_rows(spark, awkward, empty, op):
    docs, labels = labelled(spark, 60)
    got = op.classify(awkward.unionByName(docs.where("doc_id > 40").withColumn("doc_id", F.col("doc_id") + 1000)), labels).collect()
    assert len(got) == awkward.count() + 19 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert op.classify(empty, labels).count() == 0
    none = op.classify(awkward, labels.limit(0)).collect()
    assert len(none) == awkward.count() and {r.score for r in none} == {0.5}


# 3: top-k


def brute_top_k(rows, k):
    ok = [(i, [(Fraction(float(x)) * 64).__floor__() for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({i: v for i, v in ok if i % 20 == 0}.items()):
        best = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=40).astype(np.float32)]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(500, None), (501, []), (520, [float("nan")] * 40), (521, [None] * 40), (None, rows[0][1]), (540, [1.0, 2.0]), (541, [3.0, 4.0]), (560, [1e15] * 40)]
    rows += [(580, [1e15, 1.0] + [0.5] * 38), (581, [-1e300, 2.0] + [0.25] * 38), (583, [3e6 + i / 7 for i in range(40)]), (600, [-2e6 + i / 3 for i in range(40)]), (601, [3e6 + i / 7 + 1 / 64 for i in range(40)]), (602, [1.7e308] * 40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = topk.top_k(df, df.where("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == brute_top_k(rows, 20)
    assert topk.top_k(df.limit(0), df).count() == topk.top_k(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 20])
def test_top_k_in_rounds(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "CANDIDATES", 4)
    monkeypatch.setattr(topk, "GROUP", 4)
    monkeypatch.setattr(topk, "ROUND", 2)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=36).astype(np.float32)]) for i in range(150)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(60)] + [(i, rows[5][1]) for i in range(7, 12)]  # ties and repeated ids
    rows += [(300, [1e9 * x for x in rows[3][1]]), (301, [-2e9 * x for x in rows[4][1]]), (302, [4e16] * 36), (320, [0.0] * 36)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 20 = 0"), k).collect())) == brute_top_k(rows, k)


def test_top_k_sql(spark, sf_dir):
    check(spark, sf_dir, queries.op3_exact_top_k, queries.OP3_SQL)


# 4: SimHash


def brute_fingerprint(body, size=4):
    words = (body or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(n, linked):
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == root:
            return root
        root = new
    return root


def test_simhash(spark, awkward):
    rng = random.Random(2)
    base = text(rng, 200).split()
    near = [(100 + i, " ".join(base[:k] + ["other"] + base[k:]), "a", 1, 0.0, "z") for i, k in enumerate(rng.sample(range(200), 12))]
    docs = awkward.unionByName(spark.createDataFrame(near, D)).where("doc_id is not null")
    rows = sorted({(r.doc_id, r.text) for r in docs.collect()})
    fps = [brute_fingerprint(t) for _, t in rows]
    root = components_of(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    want = {(rows[i][0], f"{fps[i]:016x}", rows[root[i]][0]) for i in range(len(rows))}
    got = simhash.near_duplicates(docs).collect()
    assert {tuple(r) for r in got} == want and len(got) == docs.count()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(awkward).count() == awkward.count()


@pytest.mark.parametrize("most", [8, 2048])
def test_dense_shards_lose_no_link(spark, monkeypatch, most):
    monkeypatch.setattr(shards, "MAX_SHARD", most)
    monkeypatch.setattr(shards.deal, "__defaults__", (most,))
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = [int(base[i % 3]) ^ sum(1 << int(b) for b in rng.choice(20, 2)) for i in range(90)]
    df = spark.createDataFrame([(i, f if f < 2**63 else f - 2**64) for i, f in enumerate(fps)], "doc_id bigint, fp bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: df)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, radius=4).collect()}
    root = components_of(90, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert got == {i: root[i] for i in range(90)}


def test_layouts_leave_whole_blocks():
    for n in (1, 10**6, 10**9, 10**12):
        masks = simhash.layout(n, 4)
        rng = random.Random(n)
        for _ in range(200):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flip & m == 0 for m in masks)


def test_similar_documents(spark, awkward):
    rng = random.Random(4)
    rows = []
    for g in range(30):
        base = text(rng, 120).split()
        for c in range(4):
            words = base[:]
            for _ in range(c):
                words[rng.randrange(120)] = "changed"
            rows.append((1000 + g * 4 + c, " ".join(words), "a", 1, 0.0, "z"))
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, D)).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t, *_ in rows}
    for i in got:
        g = (i - 1000) // 4 * 4 + 1000
        assert g <= got[i] <= g + 3
        if len(sets[i] & sets[g]) / len(sets[i] | sets[g]) >= 0.85:
            assert got[i] == g
    assert simhash.similar(awkward).count() == awkward.count()


def test_similar_links_by_whole_sets(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for g in range(60):  # about 0.55 to 0.9, on both sides of the threshold
        base = text(rng, 200).split()
        other = base[:]
        for at in rng.sample(range(0, 200, 6), 2 + g % 10):
            other[at] = "changed"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        a, b = ({tuple(x[k : k + 5]) for k in range(196)} for x in (base, other))
        want[2 * g + 1] = 2 * g if 5 * len(a & b) >= 4 * len(a | b) else 2 * g + 1
    filler = "same old words again " * 60  # equal fingerprints if repeats counted, yet hardly a shingle in common
    rows += [(500, filler + text(rng, 40)), (501, filler + text(rng, 40))]
    want |= {500: 500, 501: 501}
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    wrong = {i for i in want if got[i] != want[i]}
    assert not {i for i in wrong if want[i] == i}  # none deleted that is not alike
    assert len(wrong) <= 2  # a pair may miss all trees


@pytest.mark.parametrize("n", [1000, 1 << 23, 1 << 25, 1 << 28])
def test_recall_holds_at_any_size(n):
    share = np.arccos(1.6 / 1.8) / np.pi
    trees = simhash.blocks(n, 6, share)
    rng = np.random.default_rng(2)
    flips = np.packbits(rng.random((4000, 384)) < share, axis=1, bitorder="little").view(np.uint64)
    wide = simhash._layers(flips, trees)
    met = np.zeros(len(flips), bool)
    for word, mask in trees:
        met |= wide[:, word] & np.uint64(mask) == 0
    assert (~met).mean() < 0.016
    assert n >> trees[0][1].bit_count() <= 2 * simhash.AIM


# 6: lines


def test_line_dedup_sql(spark, sf_dir):
    check(spark, sf_dir, queries.op6_line_dedup, queries.OP6_SQL)


def test_line_dedup_on_awkward_rows(spark, awkward, empty):
    got = line_dedup.dedup(awkward).collect()
    assert len(got) == awkward.count() and got[0].__fields__ == awkward.drop("n_lines").columns + ["n_lines", "n_dropped"]
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [by[i][0].n_dropped for i in (1, 2, 3, 20, 21, 25)] == [0, 0, 0, 0, 1, 1]  # two copies are no recurrence; digits are a field
    assert by[21][0].text.count("\n") == 0 and by[20][0].text.startswith("Licence")
    assert by[4][0].text is None and by[4][0].n_lines == 0 and by[5][0].n_lines == 1 and by[10][0].n_lines == 3
    assert line_dedup.dedup(empty).count() == 0


def test_line_template_generalises_a_field(spark):
    rows = [(i, f"report of the station {name} was filed today again twice") for i, name in enumerate("ab ab ab cd ef gh".split())]
    rows.append((9, "report of the sea and land was sunk by other ships"))
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 0}


def test_line_templates_of_a_leaf_are_a_list(spark, tmp_path):
    rng = random.Random(12)
    names = rng.sample([a + b for a in WORDS for b in WORDS], 60)
    lines = ["click here to read more about us today again"] * 9
    lines += [f"click here to subscribe to our {n} letter now" for n in names[:20]]
    lines += [f"click here to {n} with the other people there" for n in names[20:26]]
    lines += [f"click here to {a} {b} {c} {d} whatever it" for a, b, c, d in zip(names[26:34], names[34:42], names[42:50], names[50:58])]  # mostly fields: no template
    rng.shuffle(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").withColumns({"drop": F.lit(1), "k": F.lit(2), "doc": F.lit(3), "_k": F.lit(4), "lines": F.lit(5)})
    got = line_dedup.dedup(df).collect()
    dropped = defaultdict(int)
    for r in got:
        assert (r.drop, r.k, r.doc, r._k, r.lines) == (1, 2, 3, 4, 5)
        dropped["read" if "read" in lines[r.doc_id] else "subscribe" if "subscribe" in lines[r.doc_id] else "people" if "people" in lines[r.doc_id] else "own"] += r.n_dropped
    assert dropped == {"read": 8, "subscribe": 19, "people": 5, "own": 0}
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path), queries.op6_line_dedup, queries.OP6_SQL)


def _generated(spark, what):
    """Rows that Spark's Generate nodes of `what` have made so far, in all queries."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    executions = store.executionsList()
    for i in range(executions.size()):
        at = executions.apply(i).executionId()
        nodes, metrics = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for n in (nodes.apply(k) for k in range(nodes.size())):
            if n.name() == "Generate" and what in n.desc():
                for m in (n.metrics().apply(k) for k in range(n.metrics().size())):
                    if m.name() == "number of output rows" and metrics.contains(m.accumulatorId()):
                        total += int(metrics.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_lines_that_only_begin_alike_are_not_taken_apart(spark, tmp_path):
    rng = random.Random(21)
    lines = [f"this is how {text(rng, 40)}" for _ in range(400)]
    before = _generated(spark, "posexplode(t")
    assert sum(r.n_dropped for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()) == 0
    assert _generated(spark, "posexplode(t") - before < 400  # each has 43 words
    other = [text(rng, 40) for _ in range(3)]
    lines += [f"this is how {' '.join(w + 'y' if j in odd else w for j, w in enumerate(x.split()))}" for x in other for odd in ((1, 9), (9, 30), (1, 39), (9, 30))]
    lines += [f"that was when {' '.join(rng.choice('ab') if j % 5 else rng.choice(WORDS) + str(rng.randrange(9)) for j in range(12))}" for _ in range(500)]
    rng.shuffle(lines)
    spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path), queries.op6_line_dedup, queries.OP6_SQL)


@pytest.mark.parametrize("agree,leading", [(0.8, 3), (0.5, 0), (0.3, 3), (0.8, 9)])
def test_maskable_lines_lose_no_template(spark, agree, leading):
    rng = random.Random(8)
    rows = list({tuple("xyz"[: min(3, n)]) + tuple(rng.choice("abcdefgh") for _ in range(n - 3)) for n in (4, 5, 6, 11) for _ in range(60)})
    weights = [rng.choice((1, 1, 2, 4)) for _ in rows]
    rest = spark.createDataFrame([(len(t), i, i, n, list(t)) for i, (t, n) in enumerate(zip(rows, weights))], "leaf bigint, line bigint, line2 bigint, n bigint, t array<string>")
    got = {r.line for r in line_dedup._maskable(rest, leading, agree, 3).collect()}
    counts, shapes = defaultdict(int), defaultdict(list)
    for t, n in zip(rows, weights):
        for j, w in enumerate(t):
            counts[len(t), j, w] += n
    for i, t in enumerate(rows):
        shape = tuple("" if j >= leading and counts[len(t), j, w] < 3 else w for j, w in enumerate(t))
        if "" in shape and len(t) - shape.count("") >= agree * len(t):
            shapes[shape].append(i)
    wanted = {i for v in shapes.values() if sum(weights[i] for i in v) >= 3 for i in v}
    assert wanted <= got


# 7: embeddings


@pytest.mark.parametrize("most", [16, 2048])
def test_embedding_links(spark, monkeypatch, most):
    monkeypatch.setattr(shards.deal, "__defaults__", (most,))
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        centre = rng.normal(size=24)
        for c in range(12):
            rows.append((g * 12 + c, [float(x) for x in centre + rng.normal(size=24) * 0.13 * (c > 3)], g % 3))
    rows += [(200, rows[0][1], None), (201, None, 1), (202, [0.0] * 24, 1), (203, [float("inf")] * 24, 1), (204, [x * 2 for x in rows[0][1]], 0), (205, [1.0, 0.0], 1), (206, [2.0, 0.0], 1), (207, [], 1), (208, [None] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    ok = lambda r: r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if ok(r) else None for r in rows]
    linked = lambda i, j: i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98
    root = components_of(len(rows), linked)
    want = {(rows[i][0], sum(linked(i, j) for j in range(len(rows))), rows[root[i]][0], root[i] == i) for i in range(len(rows))}
    got = {tuple(r) for r in embed_dedup.near_duplicates(df).collect()}
    assert len(want - got) <= 2 and sum(x[1] for x in want) > 200
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.999, 0.001], 0), (3, [0.001, 0.999], 0)], df.schema)
    assert sorted(map(tuple, embed_dedup.near_duplicates(twice).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    strange = df.limit(2).union(spark.createDataFrame([(None, rows[0][1], 0), (0, rows[0][1], 0)], df.schema))
    assert embed_dedup.near_duplicates(strange).count() == 4


def test_codes_estimate_without_bias():
    rng = np.random.default_rng(3)
    dim, err = 64, []
    for _ in range(200):
        a, b = (v / np.linalg.norm(v) for v in rng.normal(size=(2, dim)))
        q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        s = np.sign(a @ q) / 8
        err.append((s @ (b @ q)) / (s @ (a @ q)) - a @ b)
    assert abs(np.mean(err)) < 0.03


# 8: URLs


def test_url_filter_sql(spark, sf_dir):
    check(spark, sf_dir, queries.op8_url_filters, queries.OP8_SQL)


def test_url_filter(spark):
    hosts = ["example.com", "www.example.com", "a.b.net", "net", "example.com.", "xcom", "com", "EXAMPLE.com:80", "b.net"]
    paths = ["", "/", "/en/", "/en/x?q", "/es/a#b", "/fr", "/fr/z", "?x", "#y"]
    urls = [(i, f"http://{h}{p}", "r") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(900, None, "r"), (901, "", "r"), (902, "no scheme", "r"), (903, "x://y://com/", "r"), (5, "http://com/", "r"), (5, "http://com/", "r")]
    rules = [*queries.URL_RULES, ("b.net", "/fr/z", "block"), ("b.net", "/fr/z", "allow"), ("com", "/en/x", "block"), ("example.com", "", "block")]
    df = spark.createDataFrame(urls, "page_id bigint, url string, rule string")
    got = url_filter.judge(df, url_filter.rules_frame(spark, rules)).collect()
    assert len(got) == len(urls)
    for r in got:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:n].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[n:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2]), r
    odd = df.select("page_id", "url", F.lit(1).alias("best"), F.lit(2).alias("_rest"), F.lit(3).alias("raw"), F.lit(4).alias("n"))
    other = url_filter.judge(odd, url_filter.rules_frame(spark, rules)).collect()
    assert sorted((r.page_id, str(r.rule), r.verdict) for r in other) == sorted((r.page_id, str(r.rule), r.verdict) for r in got) and {(r.best, r._rest, r.raw, r.n) for r in other} == {(1, 2, 3, 4)}
    assert url_filter.judge(df, url_filter.rules_frame(spark, [])).where("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.judge(df.limit(0), url_filter.rules_frame(spark, rules)).count() == 0


# 9: mixing


def test_mixing_sql(spark, sf_dir):
    check(spark, sf_dir, queries.op9_mixing, queries.OP9_SQL)


def test_timetable_is_fair(spark):
    shares = {"a": 7, "b": 3, "c": 1, "d": 12, None: 5, "e": 1}
    rows = mixing.timetable(spark.createDataFrame(list(shares.items()), "source string, share int")).orderBy("time").collect()
    period = sum(shares.values())
    assert [r.time for r in rows] == list(range(period))
    done = defaultdict(int)
    for t, r in enumerate(rows):
        assert r.release <= t < r.deadline and r.nth == done[r.source]
        done[r.source] += 1
        for s, a in shares.items():
            assert abs(done[s] - Fraction(a * (t + 1), period)) < 1


def test_mixing_keeps_every_row_and_the_shares(spark, awkward, empty):
    rng = random.Random(0)
    rows = [(i, "x" * rng.randrange(50, 400), "abc"[min(2, i % 7)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "source string, share int")
    got = mixing.mix(df, weights, block_bytes=2000, bucket=64).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    last = min(max(r.slot for r in got if r.source == s) for s in "abc")
    for t in range(10, last, 7):
        for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            assert abs(len({r.slot for r in got if r.source == s and r.slot < t}) - w * t) < 1
    assert all(r.release <= r.slot < r.deadline for r in got)
    for s in "abc":
        total = 0
        for r in sorted((r for r in got if r.source == s), key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id)):
            assert r.block == total // 2000
            total += len(r.text) + 1
    assert mixing.mix(awkward).count() == awkward.count() and mixing.mix(empty).count() == 0
    assert mixing.mixed(awkward).columns == awkward.columns and mixing.mixed(awkward).count() == awkward.count()
    some = mixing.mix(df, weights.where("source <> 'a'")).where("slot is null")
    assert some.count() == df.where("source = 'a'").count()


def test_timetable_of_very_many_sources(spark):
    weights = spark.range(30_000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.when(F.col("id") == 7, 9000).when(F.col("id") % 10_000 == 9, 3).otherwise(1).cast("int").alias("share"))
    weights = weights.where("source <> 's7'").union(spark.createDataFrame([("s7", 40)], "source string, share int"))
    rows = mixing.timetable(weights).collect()
    period = 29_996 + 9 + 40
    assert sorted(r.time for r in rows) == list(range(period)) and all(r.release <= r.time < r.deadline and r.period == period for r in rows)


def test_mixing_deals_out_rows_without_id_and_keeps_other_columns(spark):
    kind = "doc_id bigint, text string, source string, period int, _h string, hash string, share double, slot int, n bigint"
    rows = [(None, "x" * (i % 50), "ab"[i % 2], 1, "h", "k", 0.5, i, 2) for i in range(6000)] + [(i % 40, "y" * 30, "a", 1, "h", "k", 0.5, i, 2) for i in range(400)]
    df = spark.createDataFrame(rows, kind)
    out = mixing.mix(df, block_bytes=1000, bucket=100)
    got = out.collect()
    assert len(got) == 6400 and out.columns == [c for c in df.columns if c != "slot"] + ["block", "release", "deadline", "slot"]
    size = defaultdict(int)
    for r in got:
        size[r.source, r.block] += len(r.text) + 1
        assert r.release <= r.slot < r.deadline and r.period == 1 and r._h == "h" and r.share == 0.5
    for s in "ab":
        blocks = sorted(b for k, b in size if k == s)
        assert blocks == list(range(len(blocks))) and all(949 <= size[s, b] <= 1051 for b in blocks[:-1])
    assert sorted(map(str, mixing.mixed(df).collect())) == sorted(map(str, df.collect()))


# 10: suffixes


def common_prefix(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("block,range_,small", [(1 << 17, 8192, 1024), (4, 8192, 1024), (16, 4, 0), (1 << 17, 8192, 0), (7, 3, 1)])
def test_suffix_order_and_common_prefixes(monkeypatch, block, range_, small):
    for name, value in (("BLOCK", block), ("RANGE", range_), ("SMALL", small)):
        monkeypatch.setattr(induced, name, value)
    rng = np.random.default_rng(block)
    for trial in range(60):
        n, letters = int(rng.integers(1, 150)), int(rng.integers(1, 5))
        body = rng.integers(0, letters, n).astype(np.uint16)
        if trial % 3 == 0:
            body = np.tile(body[: max(1, n // 7)], 8)[:n]
            n = len(body)
        parts = list(induced.suffixes(body, letters, memory=(1 << 20, 64)[trial % 2]))
        got, common = (np.concatenate([x[k] for x in parts]).tolist() for k in (0, 1))
        text_ = body.tolist()
        want = sorted(range(n), key=lambda i: text_[i:])
        assert got == want and common == [0, *(common_prefix(text_[a:], text_[b:]) for a, b in zip(want, want[1:]))]


def test_suffixes_of_a_text_far_beyond_memory():
    rng = np.random.default_rng(8)
    base = rng.integers(1, 40, 3000).astype(np.uint16)
    body = np.concatenate([np.append(base[a : a + 150], 0) for a in rng.integers(0, 2800, 2000)])
    parts = list(induced.suffixes(body, 41, reach=100, memory=20_000))  # the text alone has 600,000 bytes
    got, common = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    assert np.array_equal(np.sort(got), np.arange(len(body)))
    raw = body.astype(">u2").tobytes()
    for i in rng.integers(1, len(body), 3000).tolist():
        a, b = (raw[2 * int(got[i - 1 + k]) :][:508] for k in (0, 1))
        same = common_prefix(list(a[::2]) and [a[j : j + 2] for j in range(0, len(a), 2)], [b[j : j + 2] for j in range(0, len(b), 2)])
        assert same >= 100 <= common[i] or (a < b and common[i] == same)


def brute_repeats(rows):
    seen, out = set(), set()
    for doc_id, body in rows:
        data = (body or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.add((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("many,held", [(256, 1 << 24), (2, 64)])
def test_repeats(spark, awkward, monkeypatch, many, held):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    rng = random.Random(9)
    passage, line = text(rng, 80), text(rng, 11)[:98]
    rows = [(200 + i, f"{text(rng, 20)} {line} {text(rng, 20)} {passage[rng.randrange(100) :]} {text(rng, 5)}", "a", 1, 0.0, "z") for i in range(25)]
    docs = awkward.where("doc_id is not null").unionByName(spark.createDataFrame(rows, D)).repartition(4)
    order = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: r[0])
    got = suffix_dedup.remove_repeats(docs).collect()
    assert {tuple(r) for r in got} == brute_repeats(order) and len(got) == docs.count()
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(awkward).count() == awkward.count()


def test_frequent_anchors_are_those_above_an_even_share(spark):
    wanted = spark.range(10_300).select(F.when(F.col("id") < 300, F.lit(-1)).otherwise(F.col("id")).alias("h"))
    assert suffix_dedup._frequent(wanted, 4).count() == 0  # 300 of 10,300 rows: by cells they would be several times as many
    assert [tuple(r) for r in suffix_dedup._frequent(wanted, 400).collect()] == [(-1, 300)]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_equal_cells_go_on_once(size):
    # (kind, part, shard, doc, k, pack, length, body), as sorted
    rows = [(0, 9, 0, 7, 1, 64, 150, None), (1, 4, 4, 5, 1, 32, 2, b"c")]
    rows += [(2, 3, 8, doc, 1, pack, 4, b"a") for doc, pack in ((1, 16), (1, 16), (1, 48), (2, 16))]
    rows += [(2, 3, 9, 1, 1, 16, 4, b"b"), (2, 6, 9, 0, 1, 16, 3, b"d"), (2, 6, 9, 4, 1, 16, 3, b"d")]
    schema = pa.schema([(n, pa.binary() if n == "body" else pa.int32() if n == "kind" else pa.int64()) for n in ("kind", "part", "shard", "doc", "k", "pack", "length", "body")])
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    got = [tuple(r.values()) for b in suffix_dedup._first_cells(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    assert got == [
        (0, 0, 7, 1, 64, 150, None), (1, 4, 5, 1, 32, 2, b"c"), (2, 8, 1, 1, 16, 4, b"a"), (0, 8, 1, 1, 48, 103, None), (0, 8, 2, 1, 16, 103, None),
        (2, 9, 1, 1, 16, 4, b"b"), (2, 9, 0, 1, 16, 3, b"d"), (0, 9, 4, 1, 16, 102, None),
    ]


def test_repeats_of_the_documents_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert {tuple(r) for r in queries.op10_suffix_array_dedup(spark, sf_dir).collect()} == brute_repeats(rows)


def test_repeats_of_many_texts_without_an_id(spark):
    rng = random.Random(3)
    shared = text(rng, 30)
    rows = [(None, f"{text(rng, 20 + i % 9)} {shared if i % 2 else ''} {text(rng, 4)}") for i in range(3000)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), with_text=True).collect()
    order = sorted((r[1] for r in rows), key=lambda x: int(np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).view(np.int64)))  # as xxhash64 of Spark
    assert sorted(tuple(r)[:5][1:] for r in got) == sorted(x[1:] for x in brute_repeats([(None, x) for x in order]))


def test_anchors_in_pieces_cover_every_window(monkeypatch):
    data = np.random.default_rng(4).integers(0, 3, 5000).astype(np.uint8)
    ends = np.array([len(data)])
    at = lambda found: {s: p for _, place, first, last, *_ in found for p, a, b in zip(place, first, last) for s in range(a, b + 1)}
    whole = at(suffix_dedup._in_pieces(data, ends))
    monkeypatch.setattr(suffix_dedup.anchors, "CHUNK", 700)
    pieces = [f for f in suffix_dedup._in_pieces(data, ends)]
    assert len(pieces) > 5 and at(pieces) == whole and sorted(whole) == list(range(4901))
    assert sum(int((last - first + 1).sum()) for _, _, first, last, *_ in pieces) == 4901


def test_repeats_in_a_text_of_more_than_8_mb(spark):
    rng = np.random.default_rng(6)
    body = (rng.integers(0, 26, 9_000_000) + 97).astype(np.uint8)
    passage = body[50:550].copy()
    spots = [(1 << 20) - 250, 8 * (1 << 20) - 300, 8_900_000]
    for i, s in enumerate(spots):
        body[s - 1], body[s + 500] = 65 + i, 75 + i
        body[s : s + 500] = passage
    long = body.tobytes().decode()
    rows = [(1, "C" + passage[100:400].tobytes().decode() + "D"), (2, long), (3, "E" + long[8_500_000:8_500_300] + "F")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (302, 0, 0), 2: (9_000_000, 300 + 3 * 500, 4), 3: (302, 300, 1)}
