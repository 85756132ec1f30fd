"""The training-data operators on odd rows, against brute force or an exact round trip."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumenfold.llm import bpe, embedding_dedup, exact_dedup, mixing, near_dedup, pii, sharding, substring_dedup
from lumenfold.llm import toxicity, url_filter

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(60)]
LONG = [f"x{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


BASE = prose(120)
NEAR = BASE.split()
NEAR[50] = "changed"
TEXTS = [
    None, "", " \t\n", "one two", "One  TWO", "a b c d e", BASE, BASE, BASE.upper(), " ".join(NEAR), BASE + " tail",
    prose(200) + " " + " ".join(LONG[:80]), prose(30) + " " + " ".join(LONG[20:90]), " ".join(LONG), "z" * 30_000,
    "é😀 \x0b中文 don't  \u00a0x", "call +1 (988) 555-2485 or a.b@c.de, 10.0.0.256 1.2.3.4 card 4041894974608795",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src" + str(i % 3) if i % 5 else None, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string").cache()


def found(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(t, lower=False):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def groups(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert near_dedup.near_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert sharding.shard_rows(none).count() == 0
    assert mixing.rates(none).count() == 0 and mixing.mix(none).count() == 0
    assert pii.find_pii(none, pii.train(none)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_docs(none, toxicity.train(none, labels)).count() == 0
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_exact_dedup(docs):
    told = found(exact_dedup.exact_dedup(docs, digest_all=True))
    by = defaultdict(list)
    for i, t in enumerate(TEXTS):
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    for t, ids in by.items():
        keep = min(ids, key=lambda i: (-len(TEXTS[i] or ""), i))
        for i in ids:
            r = told[i]
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), i == keep)
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_near_dedup(docs):
    sets = []
    for t in TEXTS:
        w = words(t, True)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(len(sets), links)
    told = found(near_dedup.near_dedup(docs))
    assert [(told[i].component_id, told[i].n_shingles, told[i].kept) for i in told] == [(want[i], len(sets[i]), want[i] == i) for i in told]


def test_near_dedup_links_beside_the_pivot(spark):
    """Chains and stragglers of one bucket are linked though the pivot misses them."""
    rows, w = [], list(LONG[:60])
    for i in range(40):
        w[(i * 7) % 60] = f"v{i}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for _, t in rows]
    links = [(a, b) for a in range(40) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    told = found(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [told[i].component_id for i in range(40)] == groups(40, links)


def test_sketch_fills_every_bin_and_estimates():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64))
    for n in (1, 3, 300):
        assert (near_dedup.sketch(a[:n]) < near_dedup._EMPTY).all()
    same = (near_dedup.sketch(a[:240]) == near_dedup.sketch(a[60:])).mean()
    assert abs(same - 180 / 300) < 0.2


def test_substring_dedup(docs):
    count = Counter(tuple(w[k : k + 35]) for w in map(words, TEXTS) for k in range(len(w) - 34))
    told = found(substring_dedup.substring_dedup(docs))
    for i, t in enumerate(TEXTS):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (told[i].n_words, told[i].n_removed) == (len(w), sum(gone))
        assert told[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_bpe_equals_tiktoken_and_round_trips(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.encoder(path, P.PATTERN)
    ranks = {k.encode("latin-1"): v for k, v in own.pairs.ranks.items()}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    told = found(bpe.encode_docs(docs, path, P.PATTERN, with_ids=True))
    for i, t in enumerate(TEXTS):
        want = other.encode_ordinary(t or "")
        assert told[i].ids == want and told[i].n_tokens == len(want)
        assert told[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert told[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    for _ in range(300):
        t = "".join(RNG.choice("abé 中1\n'st\u2009") for _ in range(40))
        assert own.encode(t) == ",".join(map(str, other.encode_ordinary(t)))


def test_base_spans_equal_plain_patterns():
    patterns = {1: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 2: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 3: r"[0-9]([\x20-]?[0-9])+", 4: r"\+[0-9][\x20().0-9-]+[0-9]"}
    for _ in range(3000):
        t = "".join(RNG.choice("a1@.+- ()25%_x") for _ in range(50))
        want = []
        for k, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if k == 2 and any(int(x) > 255 for x in m[0].split(".")) or k == 3 and not (13 <= len(d) <= 19 and pii.luhn(d)) or k == 4 and not 9 <= len(d) <= 15:
                    continue
                want.append((k, *m.span()))
        assert pii.base_spans(t) == want


def test_pii_adds_and_keeps(docs):
    cards = ["4041894974608795", "4785380592391135"]
    told = [f"+1 ({a}) 555-{b}" for a, b in ((988, 2485), (239, 1768), (269, 3296))] + cards + ["12", "2024-05-06", "3.14"]
    model = pii.SemiCrf().learn([v for t in told * 6 for v in pii.variants(t, pii.base_spans(t))])
    assert model.decode("(314) 555-6532") == [(4, 0, 14)]
    r = found(pii.find_pii(docs, model))
    last = r[len(TEXTS) - 1]
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone) == (1, 1, 1, 1)
    assert r[0].spans == r[1].spans == "" and r[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_sharding_moves_only_into_the_new_shard(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    told = sharding.shard_rows(rows).toPandas()
    moved = told[told.shard != told.grown_shard]
    assert set(moved.grown_shard) == {8} and 200 < len(moved) < 500
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in told.groupby("shard"))
    assert set(told["size"]) == {2} and len(set(told.shard)) == 8


def test_mixing_targets(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 10), ("c", 500), (None, 50)], "source string, source_size long")
    told = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert sum(told.values()) == pytest.approx(660)
    assert told["a"] == pytest.approx(300) and told["b"] == pytest.approx(30) and told[None] == pytest.approx(150)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    rated = mixing.rates(docs).toPandas()
    for _, g in rated.groupby("source"):
        assert abs((g.copies * g["size"]).sum() / g.target.iloc[0] - 1) < 0.05 and g.copies.max() <= 3
    assert mixing.mix(docs).count() == rated.copies.sum()


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 32)).astype(np.float32)
    x[100:160] = x[100] + rng.standard_normal((60, 32)).astype(np.float32) * 0.2
    rows = [(i, [float(v) for v in x[i]], int(i % 300 > 150)) for i in range(700)]
    rows += [(700, None, 1), (701, [0.0] * 32, 1), (702, rows[0][1], None), (703, [float("nan")] * 32, 1), (704, [1.0, None], 1)]
    told = found(embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), "vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    label = np.array([r[2] for r in rows[:700]])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = np.array([told[i].n_links for i in range(700)])
    assert near.sum() > 500 and (got <= near.sum(axis=1)).all() and got.sum() >= 0.97 * near.sum()
    assert all(told[i].n_links == 0 and told[i].kept for i in range(700, 705))


def test_urls(spark):
    urls = [None, "no", "HTTP://A.Example.COM/en/12?x", "http://example.com/en/7x", "http://x.net/de/1#f", "http://xorg/es/", "s://q.example.net/de/8"]
    told = found(url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")
    assert [(told[i].host, told[i].path, told[i].rule) for i in range(7)] == [
        ("", "", None), ("", "", None), ("a.example.com", "/en/12", "com/en/"), ("example.com", "/en/7x", "example.com/en/7"),
        ("x.net", "/de/1", "net/de/"), ("xorg", "/es/", None), ("q.example.net", "/de/8", "example.net/de/8"),
    ]
    assert [told[i].verdict for i in (2, 3, 4, 6)] == ["block", "allow", "block", "allow"]


def test_toxicity_separates(spark):
    texts = [prose(60) + (" grumble snark " if i % 4 == 0 else " ") + prose(40) for i in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    told = toxicity.score_docs(rows, toxicity.train(rows, labels)).toPandas()
    assert (told.predicted == (told.doc_id % 4 == 0)).mean() > 0.97


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, now, d).cache()
        assert out.columns == docs.columns, name
        if name in ("exact_dedup", "near_dedup"):
            told = {"exact_dedup": exact_dedup.exact_dedup, "near_dedup": near_dedup.near_dedup}[name](now)
            assert out.count() == told.filter("kept").count()
        now = out
    assert corpus_pipeline.run(spark, d).count() == now.count()
