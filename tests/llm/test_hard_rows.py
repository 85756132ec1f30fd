"""Ids that are null or shared, columns with clashing names, odd texts, both sides of every count switch; and each method
against a brute-force version of itself."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import bpe, exact_dedup, mixing, near_dedup, pii, sharding, substring_dedup, toxicity, url_filter

RNG = random.Random(8)
#: Names that operators use inside, or add.
CLASHES = ["row", "k1", "K2", "n", "copies", "rate", "of", "seed", "kept", "component_id", "Score", "predicted", "__n", "__rate", "__id", "file", "place"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def prose(n, r=RNG):
    return " ".join(r.choice([f"w{i}" for i in range(90)]) for _ in range(n))


def odd_rows():
    r = random.Random(8)
    base = prose(90, r)
    near = base.split()
    near[40] = "other"
    passage = " ".join(f"p{i}" for i in range(60))
    return [
        (1, base, "a"), (None, " ".join(near), "a"), (1, prose(50, r) + " " + passage, "b"), (1, prose(70, r) + " " + passage, None),
        (None, None, None), (None, "", "a"), (7, None, "b"), (7, " \n", "b"), (8, base.upper(), "a"), (8, base.upper(), "a"),
        (None, passage + " " + prose(10, r), "b"), (None, passage + " " + prose(10, r), "b"), (3, "z" * 50_000, "c"), (4, "tiny text", "c"),
    ]


def odd_docs(spark, rows=None):
    made = spark.createDataFrame(odd_rows() if rows is None else rows, "doc_id long, text string, source string")
    return made.select("*", *(F.lit(7.5).alias(c) for c in CLASHES))


def reached(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(n)]


def shingles(t, size=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def components_of(rows):
    """component_id of each (id, text): the smallest id of the component that is not null."""
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = reached(len(rows), links)
    least = {t: min((rows[k][0] for k in range(len(rows)) if top[k] == t and rows[k][0] is not None), default=None) for t in set(top)}
    return [least[t] for t in top], [len(s) for s in sets]


@pytest.mark.parametrize("small", [False, True])
def test_near_dedup_by_rows(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 3), ("HUB", 2), ("BROADCAST_KEYS", 0)):
            monkeypatch.setattr(near_dedup, name, value)
    rows, w = odd_rows(), [f"x{i}" for i in range(60)]
    for i in range(40):
        w[(i * 7) % 60] = f"v{i}"
        rows.append((100 + i // 2, " ".join(w), "a"))
    rows += [(200 + i, " ".join(w[:-1] + [f"end{i}"]), "a") for i in range(12)]
    want, sizes = components_of([r[:2] for r in rows])
    told = near_dedup.near_dedup(odd_docs(spark, rows)).collect()
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in told)
    assert got == Counter((r[0], n, c, r[0] is not None and r[0] == c) for r, n, c in zip(rows, sizes, want, strict=True))


@pytest.mark.parametrize("keys", [500_000, 0])
def test_substring_dedup_by_rows(spark, monkeypatch, keys):
    monkeypatch.setattr(substring_dedup, "BROADCAST_KEYS", keys)
    rows = odd_rows()
    count = Counter(tuple(w[k : k + 35]) for w in (words(t) for _, t, _ in rows) for k in range(len(w) - 34))
    want = Counter()
    for i, t, _ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert any(k[0] is None and k[2] == 60 for k in want) or any(k[2] >= 60 for k in want)
    assert Counter(map(tuple, substring_dedup.substring_dedup(odd_docs(spark)).collect())) == want


@pytest.mark.parametrize("keys", [200_000, 0])
def test_exact_dedup_of_any_ids(spark, monkeypatch, keys):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", keys)
    rows = [(None if i is None else f"id{i}", t) for i, t, _ in odd_rows()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id string, text string, size int")
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    want = Counter()
    for t, group in by.items():
        keep = min(group, key=lambda g: (g[0] is None, -len(g[1]), g[0] or ""))[0]
        for i, _ in group:
            want[i, keep, len(group), i is not None and i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, digest_all=True).collect())) == want


def test_every_operator_takes_odd_rows_and_empty_tables(spark):
    docs, n = odd_docs(spark), len(odd_rows())
    vocabulary = P.path("byte_bpe_multi_50k.tiktoken")
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    for of, count in ((docs, n), (docs.limit(0), 0)):
        assert sharding.shard_rows(of).count() == count
        assert mixing.rates(of).count() == count
        assert mixing.mix(of).columns == docs.columns and (mixing.mix(of).count() > 0) == (count > 0)
        assert bpe.encode_docs(of, vocabulary, P.PATTERN).count() == count
        assert pii.find_pii(of, pii.SemiCrf()).count() == count
        assert toxicity.score_docs(of, model).count() == count
        clean = toxicity.without_toxic(of, model, threshold=2.0)
        assert clean.columns == docs.columns and clean.count() == count
        assert {r.Score for r in clean.collect()} <= {7.5}


def test_empty_and_null_texts_have_defined_results(spark):
    docs = odd_docs(spark, [(None, None, None), (2, "", "a")])
    assert sorted((r["size"], r.text_crc32) for r in sharding.shard_rows(docs).collect()) == [(1, 0), (1, 0)]
    assert {(r["size"], r.target, r.copies) for r in mixing.rates(docs).collect()} == {(0, 0.0, 0)}
    nothing = hashlib.sha256(b"").hexdigest()
    coded = bpe.encode_docs(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded} == {(0, nothing, nothing)}
    scores = toxicity.score_docs(docs, toxicity.Distance(toxicity.Running(b"a", b"b"), toxicity.Words("a", "", ""))).collect()
    assert len({r.score for r in scores}) == 1 and 0 <= scores[0].score <= 1


# sharding: sizes, sums and slots one by one; movement when weights change below one node


def test_shards_of_varied_texts(spark):
    rows = [(i % 250, prose(i % 9) + "é" * (i % 3)) for i in range(600)] + [(None, None), (None, "x")]
    told = sharding.shard_rows(odd_docs(spark, [(i, t, "a") for i, t in rows]), 8, cells=5).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in told) == want
    assert all(len({r.shard for r in told if r.doc_id == i}) == 1 for i in {r.doc_id for r in told})
    for s in range(8):
        assert sorted(r.slot for r in told if r.shard == s) == list(range(sum(r.shard == s for r in told)))
    assert all(r.grown_shard in (r.shard, 8) for r in told)


def test_weights_that_change_in_one_rack_move_rows_within_it_alone(spark):
    old = sharding.default_tree(8)
    new = old | {2: (*old[2][:2], 0.5), 3: (*old[3][:2], 1.5)}
    rows = spark.range(5000).select(sharding.place(F.col("id"), old).alias("a"), sharding.place(F.col("id"), new).alias("b")).collect()
    moved = Counter((r.a, r.b) for r in rows if r.a != r.b)
    assert set(moved) == {(2, 3)} and 200 < moved[2, 3] < 450
    grown = old | {3: (*old[3][:2], 2.0)}
    for a, b in spark.range(5000).select(sharding.place(F.col("id"), old), sharding.place(F.col("id"), grown)).collect():
        if a != b:  # each step goes to the node that grew: region 0, rack 1, shard 3
            assert old[b][0] == 0 and (old[a][0] != 0 or old[b][1] == 1) and (old[a][1] != 1 or b == 3)


# mixing: targets by repeated resharing, copies by the rate's floor and ceiling


def test_mixing_against_plain_resharing(spark):
    sizes = {"a": 4000, "b": 100, "c": 900, "d": 50, None: 700}
    names = sorted(k for k in sizes if k) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, full = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set()
    for _ in sizes:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        for s in open_:
            target[s] = left * weight[s] / sum(weight[o] for o in open_)
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        full |= over
        for s in full:
            target[s] = 3.0 * sizes[s]
        if not over:
            break
    rows = [(k, " ".join(["w"] * 10), s) for s, n in sizes.items() for k in range(n // 10)]
    told = mixing.rates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.source: (r.source_size, round(r.target, 6)) for r in told} == {s: (sizes[s], round(target[s], 6)) for s in sizes}
    for r in told:
        rate = target[r.source] / sizes[r.source]
        assert math.floor(rate + 1e-9) <= r.copies <= min(3, math.ceil(rate - 1e-9)) and r["size"] == 10
    again = mixing.rates(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert Counter(map(tuple, told)) == Counter(map(tuple, again))


# URLs: whole tokens, rules against plain counting, the index against plain subsets


def test_tokens_of_the_whole_url():
    a, b = (set(url_filter.tokens(u)) for u in ("http://bad.a.b.c.example.com/en/x/y/spam?k=v&n=12#f", "http://b.c.example.com/en/x/y/z"))
    assert {"h:bad", "h:a", "p:spam", "q:k", "v:k=v", "v:n=12", "v:n=0", "f:"} <= a - b and {"h:b", "h:c", "p:y"} <= a & b
    assert url_filter.tokens(None) == url_filter.tokens("no scheme") == []
    assert len(url_filter.tokens("http://" + ".".join(f"l{i}" for i in range(300)) + "/" + "x/" * 5000)) > 300


def test_mined_rules_against_plain_counting(spark):
    r = random.Random(1)
    urls = []
    for i in range(900):
        host, part = r.choice(["casino", "news", "blog"]), r.choice(["win", "read", "about"])
        urls.append((i, f"http://{host}.site{i}.test/{part}/{i}?id={i}", host == "casino" and (part == "win" or i % 50 == 0)))
    pages = spark.createDataFrame(urls, "page_id long, url string, spam boolean")
    got = set(url_filter.mine(pages, support=0.01, least=20, label="spam"))
    own = [(set(url_filter.tokens(u)), bad) for _, u, bad in urls]
    n, n_bad, least = len(own), sum(b for _, b in own), 20
    often = [t for t, c in Counter(t for s, b in own if b for t in s).items() if c >= least]
    places = defaultdict(list)
    for t in often:
        places[tuple(k for k, (s, _) in enumerate(own) if t in s)].append(t)
    often = sorted(min(ts) for ts in places.values())
    want = []
    for size in range(1, len(often) + 1):
        for c in map(frozenset, itertools.combinations(often, size)):
            held = [b for s, b in own if c <= s]
            if sum(held) >= least and sum(held) / len(held) >= 0.8 and url_filter.surely_above(sum(held) / len(held), len(held), n_bad / n):
                if not any(w <= c for w in want):
                    want.append(c)
    assert got == set(want) and frozenset({"h:casino", "p:win"}) in got
    told = {x.page_id: x for x in url_filter.filter_urls(pages, 0.01, label="spam").collect()}
    assert all((told[i].verdict == "block") == any(w <= set(url_filter.tokens(u)) for w in want) for i, u, _ in urls)


def test_index_equals_plain_subsets():
    r = random.Random(2)
    names = [f"h:{c}" for c in "abcdefgh"]
    for _ in range(200):
        rules = [frozenset(r.sample(names, r.randrange(1, 4))) for _ in range(r.randrange(6))]
        index = url_filter.inverted(rules)
        for _ in range(20):
            url = "s://" + ".".join(r.sample("abcdefgh", r.randrange(1, 8)))
            want = any(rule <= set(url_filter.tokens(url)) for rule in rules)
            assert (url_filter.judge(url, index) == "block") == want


def test_too_few_bad_urls_make_no_rule(spark):
    rows = [(i, f"http://x{i}.com/{'en/' if i < 10 else ''}{i}") for i in range(400)]
    assert url_filter.mine(spark.createDataFrame(rows, "page_id long, url string")) == []


# personal data: all segmentations of short islands, the gradient, look-alikes


def segmentations(text):
    """Every labelling of an island: runs of single `none` tokens and candidate segments of each kind."""
    at, segments = pii.lattice(text)
    ends = defaultdict(list)
    for i, j, held in segments:
        ends[i].append((j, held))

    def onward(k):
        if k == len(at) - 1:
            yield []
            return
        for rest in onward(k + 1):
            yield [(k, k + 1, 0, ())] + rest
        for j, held in ends[k]:
            for y in range(1, len(pii.KINDS) + 1):
                for rest in onward(j):
                    yield [(k, j, y, held)] + rest

    return at, list(onward(0))


def score(model, path):
    total, before = 0.0, 0
    for _, _, y, held in path:
        total += model.turns[before][y] + sum(model.spans[y][f] for f in held) * (y > 0)
        before = y
    return total


def random_model(seed):
    r = random.Random(seed)
    n = len(pii.KINDS) + 1
    return pii.SemiCrf([[r.gauss(0, 1) for _ in pii.FEATURES] for _ in range(n)], [[r.gauss(0, 1) for _ in range(n)] for _ in range(n)])


@pytest.mark.parametrize("text", ["a@b.c 12", "+1 (2) 3", "1.2 3.4", "7-8 @x", "12", "1 2 3"])
def test_decoding_is_the_best_of_all_segmentations(text):
    for seed in range(4):
        model = random_model(seed)
        at, paths = segmentations(text)
        best = max(paths, key=lambda p: score(model, p))
        assert model.decode(text) == [(y, at[i], at[j]) for i, j, y, _ in best if y]


def test_a_learning_step_is_the_gradient():
    text, gold = "1.2 3@x.y", [(1, 4, 9)]
    at, paths = segmentations(text)
    where = {p: k for k, p in enumerate(at)}
    truth = {(where[a], where[b]): y for y, a, b in gold}

    def gain(model):
        own = next(p for p in paths if {(i, j): y for i, j, y, _ in p if y} == truth)
        scores = [score(model, p) for p in paths]
        top = max(scores)
        return score(model, own) - top - math.log(sum(math.exp(s - top) for s in scores))

    model, moved, step = random_model(5), random_model(5), 1e-3
    moved._climb(len(at) - 1, pii.lattice(text)[1], truth, step)
    for name in ("spans", "turns"):
        for y, row in enumerate(getattr(model, name)):
            for f in range(len(row)):
                row[f] += 1e-5
                up = gain(model)
                row[f] -= 2e-5
                slope = (up - gain(model)) / 2e-5
                row[f] += 1e-5
                if not (name == "spans" and y == 0):
                    assert (getattr(moved, name)[y][f] - row[f]) / step == pytest.approx(slope, abs=1e-4)


def test_look_alikes_are_not_added():
    r = random.Random(4)
    phones = [f"+1 ({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}" for _ in range(30)]
    cards = [s for s in ("4" + "".join(r.choice("0123456789") for _ in range(15)) for _ in range(400)) if pii.luhn(s)]
    found = phones + cards[:30] + [".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(30)]
    model = pii.SemiCrf().learn(pii.examples(found))
    for text in ("2024-05-06", "192.168.1.300", "4111111111111112", "2001 - 2005", "3.14.2", *(t for t, _ in pii.negatives(20, seed=70))):
        assert model.decode(text) == [], text
    assert model.decode("(314) 555-6532") == [(4, 0, 14)]
    assert model.decode("+1 (988) 555 - 2485") == [(4, 0, 19)]
    assert list(pii.islands("call +1 (988) - 555 now, 7 - x 8")) == [(5, "+1 (988) - 555"), (25, "7"), (31, "8")]


def test_training_sample_is_bounded_and_whole(spark):
    rows = [(i, f"call +1 ({200 + i}) 555-{1000 + i} or {i} apples", "a") for i in range(300)]
    model = pii.train(odd_docs(spark, rows), sample=40)
    assert model.decode("+1 (314) 555-6532") == [(4, 0, 17)] and model.decode("12") == []


# toxicity: phrases of ordinary words, which no list of words can tell


def test_phrases_of_ordinary_words(spark):
    r = random.Random(1)
    ordinary = "the house river walks slowly under green light while many people carry small boxes over open water and nobody knows why less than nothing you are worth".split()
    phrase = "you are worth less than nothing".split()

    def text(bad):
        w = [r.choice(ordinary) for _ in range(150)]
        if bad:
            for _ in range(3):
                k = r.randrange(140)
                w[k:k] = phrase
        else:
            for x in phrase * 3:
                w.insert(r.randrange(len(w)), x)
        return " ".join(w)

    bad = [int(i % 4 == 0) for i in range(600)]
    texts = [text(y) for y in bad]
    model = toxicity.fit(texts[:400], bad[:400])
    assert model.words.parts[1] == "" and all(len(p) > 100 for p in model.running.parts)
    told = [model.score(t) >= 0.3 for t in texts[400:]]
    caught = sum(p and y for p, y in zip(told, bad[400:], strict=True))
    assert caught >= 0.6 * sum(bad[400:]) and sum(told) - caught <= 0.05 * 150


def test_windows_cover_every_word_and_copies_count_once():
    text = " ".join(f"n{i}" for i in range(1000)) + " " + "q" * 1000
    assert set(b" ".join(toxicity.windows(text)).split()) == set(text[: text.index(" q")].encode().split()) | {b"q" * 200}
    assert toxicity.windows("") == [] and len(toxicity.windows("one")) == 1
    few = ["you rotten thing " + prose(30) for _ in range(12)], [prose(30) for _ in range(12)]
    once = toxicity.fit([*few[0], *few[1]], [1] * 12 + [0] * 12).dump()
    assert once == toxicity.fit([*few[0], *few[0], *few[1], *few[1]], [1] * 24 + [0] * 24).dump()


# the pipeline against plain Python


def test_pipeline_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    left = [r for r in docs.collect() if model.score(r.text or "") < toxicity.THRESHOLD]
    by = defaultdict(list)
    for r in left:
        by[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    left = sorted((min(g, key=lambda r: (-len(r.text or ""), r.doc_id)) for g in by.values()), key=lambda r: r.doc_id)
    components, _ = components_of([(r.doc_id, r.text) for r in left])
    left = [r for r, c in zip(left, components, strict=True) if r.doc_id == c]
    rates = {r.doc_id: r.copies for r in mixing.rates(spark.createDataFrame(left, docs.schema)).collect()}
    pairs = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).pairs
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={k.encode("latin-1"): v for k, v in pairs.ranks.items()}, special_tokens={})
    want = Counter()
    for r in left:
        want[r.doc_id, tuple(plain.encode_ordinary(r.text or ""))] += rates[r.doc_id]
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, d).collect()) == +want


def test_pipeline_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    rows = odd_rows()
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    for name, docs in (("odd", odd_docs(spark)), ("none", odd_docs(spark).limit(0))):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        assert (corpus_pipeline.run(spark, d).count() > 0) == (name == "odd")
    now = odd_docs(spark)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        now = stage(spark, now, d).cache()
        assert now.columns == odd_docs(spark).columns and {r.kept for r in now.collect()} == {7.5}
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in now.collect()]
    assert len(texts) == len(set(texts)) and texts.count("") == 1
    assert len(texts) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in rows}) - 2  # near copies of the first


def test_dropped_rows_by_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", 0)
    assert corpus_pipeline.drop_copies(spark, odd_docs(spark), "").count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in odd_rows()})


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from lumenfold.llm import common

    class Elsewhere:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Elsewhere()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_sketch_bands_find_the_similar():
    r = np.random.default_rng(6)
    missed = 0
    for _ in range(300):
        a = r.integers(0, 2**63, 400, dtype=np.uint64)
        b = np.concatenate([a[:343], r.integers(0, 2**63, 57, dtype=np.uint64)])  # similarity 0.75
        missed += not set(near_dedup.band_keys(near_dedup.sketch(np.unique(a)))) & set(near_dedup.band_keys(near_dedup.sketch(np.unique(b))))
    assert missed == 0
