import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from maskwell.llm import components, embedding_dedup, logistic, minhash, quality, toxicity


def word(rng):
    return "".join(rng.choices("abcdefghij", k=4))


def near_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        base = [word(rng) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                own[rng.randrange(len(own))] = word(rng)
            rows.append(" ".join(own))
    return [*enumerate(rows), (900, None), (901, ""), (902, "..."), (905, "| |"), (906, "..."), (903, rows[0]), (904, rows[0].upper())]


def brute(rows, threshold=0.8):
    grams = {}
    for i, t in rows:
        w = re.findall(r"[0-9a-z_]+", (t or "").lower())
        grams[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))
    df = collections.Counter(g for c in grams.values() for g in c)
    weight = {i: {g: n * (1 + math.log(len(rows) / df[g]) / math.log(len(rows)) / 4) for g, n in c.items()} for i, c in grams.items()}
    root, texts = {i: i for i in grams}, {i: t or "" for i, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(grams)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = sum(min(v, weight[j][g]) for g, v in weight[i].items() if g in weight[j])
            total = sum(weight[i].values()) + sum(weight[j].values()) - common
            if (not grams[i] and not grams[j] and texts[i] == texts[j]) or (total and common / total >= threshold - 1e-9):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    got = minhash.near_dedup(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, seq string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


@pytest.mark.parametrize("tile", [16, 1024])
def test_a_crowded_group_against_brute_force(spark, tile):
    """Variants of one text about the threshold apart: many buckets whose members their heads don't connect."""
    rng = random.Random(9)
    base, rows = [word(rng) for _ in range(120)], []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = word(rng)
        rows.append((i, " ".join(own * (1 + (i % 10 == 0)))))
    rows += near_rows()[:100:3]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)


def test_near_duplicates_of_thue_morse_words_and_null_keys(spark):
    a = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (None, a), (None, "only here, twice and more"), (None, "only here twice and more")]
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in got) == {(1, 1, 2, True): 1, (2, 2, 1, True): 1, (None, 1, 2, False): 1, (None, None, 2, True): 2}


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_consistent_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.5, 2, 300), rng.uniform(0.5, 2, 300)
    keys = minhash.textkit.mix(np.arange(1, 2001, dtype=np.uint64))
    same = (minhash.samples(h, a, 0.0, b"x" * 16, keys) == minhash.samples(h, b, 0.0, b"y" * 16, keys)).mean()
    assert same == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)
    alone = (minhash.samples(h, a, a.sum(), b"x" * 16, keys) == minhash.samples(h, a, 0.0, b"y" * 16, keys)).mean()
    assert alone == pytest.approx(0.5, abs=0.04)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 16))
    x = [(int(i), [float(v) for v in base[i % 20] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])]) for i in range(150)]
    x += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, x[0][1]), (504, [float("inf")] + [1.0] * 15), (505, [None] + [1.0] * 15)]
    got = embedding_dedup.near_vectors(spark.createDataFrame([*x, (None, x[0][1])], "vec_id long, embedding array<float>"), tile=16).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, False)]
    got = [r for r in got if r["vec_id"] is not None]
    good = {i: np.array(v, np.float32).astype(float) for i, v in x if i < 500 or i == 503}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = {i: [j for j in unit if j != i and unit[i] @ unit[j] >= 0.9] for i in unit}
    low = {i: i for i, _ in x}
    for _ in range(20):
        for i, others in links.items():
            low[i] = min([low[i], *[low[j] for j in others]])
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (len(links.get(i, [])), low[i]) for i, _ in x}


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, n, e = embedding_dedup.quantise(x)
    product = (q.astype(float) @ q.astype(float).T) / (s[:, None] * s[None, :])
    assert (np.abs(product - x @ x.T) <= e[:, None] * n[None, :] + e[None, :] + 1e-12).all()


def test_vectors_of_an_empty_table_and_other_columns(spark):
    schema = "vec_id long, embedding array<float>, id string, n int, v string, dims int"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], "a", 1, "b", 9), (2, [1.0, 0.1], "a", 1, "b", 9), (3, [1.0], "a", 1, "b", 9)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 if i <= 60 else 100 for i in [*range(61), 100, 101]}


def labelled(spark, n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = [word(rng) for _ in range(rng.randint(10, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zznasty", "qqawful"]))
        bad = int(rng.random() < 0.3)
        body = " ".join(words)
        rows.append((i, body.upper().replace(" ", "!! ") if bad else body, "en", rng.choice(["a", "b"]), len(body)))
        labels.append((i, 1 - bad, toxic))
    rows += [(9000, None, None, None, None), (9001, "", "en", "a", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_hold_out_and_learn(spark, operator, label):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in operator(docs, labels).collect()}
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and i in truth]
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.9


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_on_an_empty_table_and_other_columns(spark, operator):
    docs, labels = labelled(spark, 60)
    more = docs.selectExpr("*", "1 as y", "'a' as x", "'b' as id", "0.1 as score", "true as held_out")
    assert operator(docs.limit(0), labels).count() == 0
    want = {r["doc_id"]: r["score"] for r in operator(docs, labels).collect()}
    assert {r["doc_id"]: r["score"] for r in operator(more, labels).collect()} == pytest.approx(want)


def test_metadata_of_rare_sources_is_not_lost(spark):
    rows = [("en", "rare", 5), (None, "a", None), (None, None, None), ("en", "a", -3), ("a", None, 0)]
    got = [r["meta"] for r in spark.createDataFrame(rows, "lang string, source string, n_chars long").select(quality.metadata().alias("meta")).collect()]
    assert all(len(m) == quality.KINDS and all(0 <= c < quality.META for c in m) for m in got)
    lang, source, size, both = zip(*got, strict=True)
    assert [len(set(x)) for x in (lang, source, size, both)] == [3, 3, 3, 5] and size[3] == size[4]


def brute_quality(docs, labels, rounds=3, limit=math.log(19)):
    """The rounds of co-training with dictionaries of counts, over the cells of single texts."""
    feats = {r["id"]: r for r in quality.featured(docs).collect()}
    truth = {r["_key"]: (r["y"], r["turn"]) for r in quality.picked(labels, 20_000, "doc_id", "quality").collect() if r["_key"] in feats}
    edges = np.quantile(np.array([feats[i]["form"] for i in truth], np.float32), np.arange(1, 32) / 32, axis=0).T.astype(np.float32)
    words = {i: sorted({int.from_bytes(f["words"][k : k + 2], "little") for k in range(0, len(f["words"]), 2)}) for i, f in feats.items()}
    measures = {i: [(k, sum(e <= np.float32(v) for e in edges[k])) for k, v in enumerate(f["form"])] for i, f in feats.items()}
    cells = {i: ([("w", c) for c in words[i]] + [("f", *m) for m in measures[i]], [("m", c) for c in feats[i]["meta"]]) for i in feats}

    def count(given):
        sums = [collections.Counter(), collections.Counter()], [0, 0]
        for i, y in given:
            sums[0][y].update(cells[i][count.view])
            sums[1][y] += 1
        return sums

    def ratio(view, labelled, given):
        count.view = view
        (a, n), (b, m) = count(labelled), count(given)
        weight = [min(1, n[k] / max(1, m[k])) for k in (0, 1)]
        share = lambda c, k: (a[k][c] + weight[k] * b[k][c] + 1) / (n[k] + weight[k] * m[k] + 2)
        return lambda c: math.log(share(c, 1)) - math.log(share(c, 0))

    own = [(i, y) for i, (y, turn) in truth.items() if turn < 6]
    given = [[], []]
    for turn in range(rounds + 1):
        text, meta = ratio(0, own, given[0]), ratio(1, own, given[1])
        x = {}
        for i in feats:
            total, n = sum(text(("w", c)) for c in words[i]), max(1, len(words[i]))
            x[i] = [total / n, total / n**0.5, *(text(("f", *m)) for m in measures[i])], [meta(("m", c)) for c in feats[i]["meta"]]
        aside = [(i, y) for i, (y, t) in truth.items() if t == 6]
        views = [quality.View.fit(np.array([x[i][k] for i, _ in aside]), np.array([float(y) for _, y in aside])) for k in (0, 1)]
        odds = {i: [float(views[k].log_odds(np.array([x[i][k]]))[0]) for k in (0, 1)] for i in feats}
        if turn < rounds:
            given = [[(i, int(z[1 - k] > 0)) for i, z in odds.items() if abs(z[1 - k]) >= limit] for k in (0, 1)]
    mixing = [(i, y) for i, (y, t) in truth.items() if t == 7]
    mixed = logistic.fit(np.array([odds[i] for i, _ in mixing]), np.array([float(y) for _, y in mixing]), penalty=0.1)
    return {i: 1 / (1 + math.exp(-(mixed[0] * z[0] + mixed[1] * z[1] + mixed[2]))) for i, z in odds.items()}


def test_quality_equals_brute_force(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    assert got == pytest.approx(brute_quality(docs, labels), abs=1e-6)


def test_quality_words_and_pairs(spark):
    texts = [(1, "One two two"), (2, "one TWO"), (3, "two one"), (4, None), (5, "w " * 400_000)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["id"]: {bytes(r["words"][k : k + 2]) for k in range(0, len(r["words"]), 2)} for r in quality.featured(docs).collect()}
    assert [len(got[i]) for i in range(1, 6)] == [4, 3, 3, 0, 2]
    assert got[2] < got[1] and len(got[2] & got[3]) == 2


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_without_labels(spark, operator):
    docs, labels = labelled(spark, 10)
    got = operator(docs, labels.limit(0)).collect()
    assert {round(r["score"], 6) for r in got} == {0.5}


def test_logistic_fits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] > x[:, 1]).astype(float)
    assert ((logistic.sigmoid(np.column_stack([x, np.ones(500)]) @ logistic.fit(x, y)) > 0.5) == y).mean() > 0.97


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kind = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    first = next(i for i, _ in texts if kind[i] == 0)
    secret = (7000, "here is password = hunter2hunter2 and more words to say for it", "en", "a", 62)
    docs = docs.unionByName(spark.createDataFrame([secret, (7001, texts[first][1], "en", "a", 1)], docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path)).cache()
        seen[name] = frame
        assert k == 4 or frame.columns == docs.columns
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    left = {r["doc_id"] for r in seen["toxicity"].collect()}
    assert sum(truth[i] for i in left if i in truth) <= 5 and sum(1 - truth[i] for i in left if i in truth) > 0.95 * sum(1 - t for t in truth.values())
    assert 7001 in {r["doc_id"] for r in seen["exact_dedup"].collect()} and first not in {r["doc_id"] for r in seen["exact_dedup"].collect()}
    clean = {r["doc_id"]: r for r in seen["secret_scans"].collect()}
    assert clean[7000]["text"] == "here is <assign> and more words to say for it" and clean[7000]["n_chars"] == len(clean[7000]["text"])
    assert {r["doc_id"] for r in frame.collect()} == set(clean)


def test_hot_keys_meet_a_broadcast_copy(spark):
    from maskwell.llm.common import looked_up

    rows = spark.range(4000).selectExpr("id", "unhex(hex(if(id % 3 = 0, 7, id))) as k", "id % 2 as w")
    table = rows.groupBy("k").agg({"id": "min"}).withColumnRenamed("min(id)", "low").filter("low % 5 <> 1")
    for how in ("inner", "left", "left_semi"):
        got, want = looked_up(rows, "k", table, 4000, how), rows.join(table, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    both = rows.groupBy("k", "w").agg({"id": "max"})
    got, want = looked_up(rows, "k", both, 4000, "left", also=("w",)), rows.join(both, ["k", "w"], "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_components_with_a_hub_and_a_chain(spark):
    edges = [(5000, i) for i in range(1500)] + [(i, i + 1) for i in range(6000, 6300)] + [(7001, 7000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(1500), 5000]} | {i: 6000 for i in range(6000, 6301)} | {7000: 7000, 7001: 7000}
