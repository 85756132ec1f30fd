"""Operators 11 to 13 against plain ones, on made rows with nulls, ties, repeats, clashing columns and hot keys."""

import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import asof_join, html_text, prefix_trie

SF = "/root/testdata/sf0.001"
EPOCH = datetime(1970, 1, 1)


# --- as-of join ---------------------------------------------------------------------------------------------------


def plain_asof(clicks, sales, hours=240):
    crc = lambda n: zlib.crc32(str(n).encode())
    us = lambda t: None if t is None else (t - EPOCH) // timedelta(microseconds=1)
    floored = lambda t, i: t if t is None or i is None or crc(i) % 2 == 0 else t // 3_600_000_000 * 3_600_000_000
    last = lambda v: (v is None, v or 0)
    orders = defaultdict(list)
    for i, client, total, at, priority in sales:
        if client is None or at is None:
            continue
        cents = None if total is None or not abs(total) < 9e16 else int((100 * total + 0.5) // 1)
        both = [(i, priority)]
        if i is not None and crc(i) % 3:
            both.append((-1 - i, None if priority is None else 6 - priority))
        for j, p in both:
            orders[client].append((floored(us(at), i), last(p), (j is None, -(j or 0)), (cents is None, -(cents or 0)), j, cents))
    once = {}
    for i, ts, client in clicks:
        key = (last(us(ts)), last(client))
        if i not in once or key < once[i][0]:
            once[i] = (key, ts, client)
    out = []
    for i, (_, ts, client) in once.items():
        t = floored(us(ts), i)
        found = [o for o in orders.get(client, ()) if t is not None and t - hours * 3_600_000_000 <= o[0] <= t]
        if not found or client is None:
            out.append((i, client, t, None, None, None, 0))
            continue
        at = max(o[0] for o in found)
        tied = [o for o in found if o[0] == at]
        best = min(tied, key=lambda o: o[1:4])
        out.append((i, client, t, best[4], t - at, best[5], len(tied)))
    return sorted(out, key=repr)


CLICKS = "click_id long, ts timestamp_ntz, client_id long, value double, sale_id string"
SALES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int, ts string, h int"


def asof(spark, clicks, sales, **more):
    c = spark.createDataFrame([(*r, 1.0, "x") for r in clicks], CLICKS)
    s = spark.createDataFrame([(*r, "x", 1) for r in sales], SALES)
    told = asof_join.click_orders(c, s, **more)
    assert told.dtypes == [(x, "bigint") for x in ("click_id", "client_id", "ts_us", "sale_id", "lag_us", "total_cents", "n_tied")]
    return sorted(map(tuple, told.collect()), key=repr)


def made_shop(seed, n, hot=0.0, span=40 * 86_400_000_000):
    rng = random.Random(seed)
    begin = datetime(2024, 3, 20)

    def time():
        if rng.random() < 0.03:
            return None
        at = begin + timedelta(microseconds=rng.randrange(span))
        return at.replace(minute=0, second=0, microsecond=0) if rng.random() < 0.3 else at

    def client():
        if rng.random() < hot:
            return 7
        return None if rng.random() < 0.04 else rng.randrange(-3, 25)

    clicks = [(rng.randrange(-50, 2 * n), time(), client()) for _ in range(n)]
    sales = [
        (i, client(), rng.choice([None, 0.0, float("nan"), 1e300, 12.345, 99.995]), time(), rng.choice([None, 1, 2, 3, 4, 5]))
        for i in range(n // 2)
    ]
    clicks += clicks[::9] + [(None, datetime(2024, 4, 1, 5, 30), 7), (None, None, 7)]
    sales += sales[::11] + [(None, 7, 3.0, datetime(2024, 4, 1, 5, 10), 1)]
    return clicks, sales


@pytest.mark.parametrize(("seed", "hot", "target"), [(1, 0.0, 32_768), (2, 0.5, 20), (3, 0.4, 7), (4, 0.9, 60)])
def test_asof_is_plain_asof(spark, seed, hot, target):
    clicks, sales = made_shop(seed, 400, hot)
    assert asof(spark, clicks, sales, target=target) == plain_asof(clicks, sales)


def test_asof_of_many_clicks_at_one_time_and_a_gap_longer_than_the_tolerance(spark):
    at = datetime(2024, 3, 31, 2, 0)
    clicks = [(i, at, 7) for i in range(600)] + [(i, at + timedelta(days=30), 7) for i in range(600, 640)]
    sales = [(i, 7, 1.0, at - timedelta(hours=k), 3) for i, k in enumerate([0, 0, 1, 239, 241])]
    sales += [(9, 7, 2.0, at + timedelta(days=20), 1), (10, 7, 2.0, at + timedelta(days=20, microseconds=-1), 1)]
    want = plain_asof(clicks, sales)
    assert asof(spark, clicks, sales, target=10) == want
    edge = asof(spark, [(4, at + timedelta(hours=240), 7), (4, at + timedelta(hours=240, microseconds=1), 7)], [(0, 7, 1.0, at, 1)])
    assert [r[3] is None for r in edge] == [False]


def test_asof_of_empty_tables(spark):
    assert asof(spark, [], [(1, 1, 1.0, EPOCH, 1)]) == []
    assert asof(spark, [(4, EPOCH, 1)], []) == [(4, 1, 0, None, None, None, 0)]


def test_asof_reads_times_without_the_sessions_zone(spark):
    clicks, sales = made_shop(9, 60)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert asof(spark, clicks, sales, target=10) == plain_asof(clicks, sales)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


# --- prefix trie --------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    built = {}
    for c, turns in own.items():
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = [t[2:] for t in own.get(base, [])[:h]] + [t[2:] for t in turns[h:]]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        bytes_ = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * bytes_ + sum(saved[x] for x in children[node])
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, f string, part int")
    return sorted(map(tuple, prefix_trie.prefix_trie(df, **more).collect()), key=repr)


def made_talks(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randrange(-40, 90)
        for turn in range(rng.randrange(0, 14)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", None, "bot"]), rng.choice([None, "", "hé", "a", "b" * 40])))
    copied = [(1000 + 5 * k, t, "user", f"same {t}") for k in range(40) for t in range(3)]
    return rows + rows[::7] + copied + [(None, 1, "user", "lost"), (2**62, 0, "user", "same 0"), (-(2**62), 0, "user", "same 0")]


@pytest.mark.parametrize(("seed", "prime"), [(1, prefix_trie.PRIME), (2, 3), (3, 7), (4, 101)])
def test_trie_is_plain_trie_also_where_fingerprints_collide(spark, seed, prime):
    rows = made_talks(seed)
    assert trie(spark, rows, prime=prime) == plain_trie(rows)


def test_trie_of_a_conversation_that_lies_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 1)
    rows = [(c, t, "user", f"{t % 7} {'x' * (t % 5)}") for c in (10, 11, 12, 25) for t in range(120 + c)] + [(3, 0, "user", "0 ")]
    for prime in (prefix_trie.PRIME, 11):
        assert trie(spark, rows, prime=prime) == plain_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert trie(spark, []) == []


def test_trie_of_the_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=repr) == plain_trie(rows)


# --- main text ----------------------------------------------------------------------------------------------------

LONG = "The cat that was on the mat is not in the house and it was seen by all of the dogs that live here. "


def main_text(html):
    return "\n".join(b[0] for b in html_text.judged(html) if b[4])


PAGES = {
    "plain": (f"<html><body><nav><a href=/>Home</a></nav><article><h1>A  title</h1><p>{LONG}<p>Short one.</article><footer>{LONG}</footer>", ["A title", LONG.strip(), "Short one."]),
    "no article": (f"<div id=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><h2>Heading</h2><p>{LONG}</p><p>Tail.</p><p>{LONG}</p><div class=site-footer>Made by us.</div>", ["Heading", LONG.strip(), "Tail.", LONG.strip()]),
    "notices and forms": (f"<header><p>{LONG}</p></header><div class='cookie-notice'>{LONG}</div><main><form><p>{LONG}</p></form><p>{LONG}</p><aside>{LONG}</aside></main>", [LONG.strip()]),
    "reader comments": (f"<article><p>{LONG}</p><section id='comments'><article class=comment-body><p>{LONG}</p></article></section></article>", [LONG.strip()]),
    "references": ("<article><h1>a &amp; b &#x41;&eacute; &am</h1><p>x&nbsp;y<!-- > <p> -->z &lt;p&gt;</p></article>", ["a & b Aé &am", "x yz <p>"]),
    "scripts": (f"<script>var t='</p><article>{LONG}';</script><style>p{{}}</style><article><p>{LONG}<script>if (a < b) {{}}</script></p></article>", [LONG.strip()]),
    "open comment": (f"<article><p>{LONG}</p></article><!-- <p>{LONG}", [LONG.strip()]),
    "open script": (f"<article><p>{LONG}</p></article><script>{LONG}", [LONG.strip()]),
    "quoted sign": (f"<article><p title='a > b'>{LONG}</p><p hidden>{LONG}</p><p style='display: none'>{LONG}</p></article>", [LONG.strip()]),
    "unclosed bold": (f"<article><p><b>{LONG}<br><p>{LONG}</p></article><div class='ad'>{LONG}</div>", [LONG.strip()] * 2),
    "links": (f"<article><p>{LONG}</p><ul><li><a href=x>{LONG}</a></li></ul><p>See <a href=y>it</a> in the house of the cat that is here.</p></article>", [LONG.strip(), "See it in the house of the cat that is here."]),
    "nothing": ("<nav>a</nav>", []),
    "empty": ("", []),
    "text alone": ("a < b and 3 > 2", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, want = PAGES[name]
    assert main_text(html) == "\n".join(want)


def test_main_text_takes_time_in_proportion():
    for piece in ("<!--", "<script>", "<p>", "<b>", "<a href='", "</p>", "<div class='x", "<", "&", "<p>a</b>", "<svg", "<article>"):
        html_text.judged(piece * 40_000)


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, "u", PAGES["plain"][0], "x"), (1, "u", PAGES["plain"][0], "y"), (None, None, None, "z"), (3, "v", "", "x"), (4, "v", f"<article><p>{LONG * 3000}</p></article>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    told = html_text.extract(pages, rows=2)
    found = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in told.collect()), key=repr)
    want = sorted(((i, u, main_text(h or ""), len(main_text(h or ""))) for i, u, h, _ in rows), key=repr)
    assert found == want and told.columns == ["page_id", "url", "blocks", "text", "n_chars"]
    assert html_text.extract(pages.filter("false")).count() == 0


def test_extract_finds_the_articles_of_the_given_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    told = {r.page_id: r.text for r in html_text.extract(pages).select("page_id", "text").collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert told[r.page_id] == "\n".join(b for b in blocks if b)


def test_an_open_block_takes_the_nearest_label_of_its_container_first():
    html = f"<div><p>{LONG}</p><p>One.</p></div><div class=ad>{LONG}</div><div><p>Two.</p></div><div class=ad>{LONG}</div>"
    assert main_text(html) == f"{LONG.strip()}\nOne."


# --- growth and hot rows of earlier operators ---------------------------------------------------------------------


def test_links_between_near_copies_stay_below_their_members(spark, monkeypatch, tmp_path):
    from lumenfold.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    seen = []
    plain = near_dedup.bridges

    def watched(members, sets, percent, turn=None):
        out = plain(members, sets, percent, turn)
        seen.append((members.count(), out.count()))
        return out

    monkeypatch.setattr(near_dedup, "bridges", watched)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    for n in (150, 600):
        seen.clear()
        rows = []
        for i in range(n):
            words = base[:]
            for k in rng.sample(range(200), 4):
                words[k] = f"x{i}_{k}"
            rows.append((i, " ".join(words)))
        told = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert seen and all(links <= members for members, links in seen)
        if n == 150:
            sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
            label = {i: i for i in sets}
            for i in sets:
                for j in range(i):
                    if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                        a, b = label[i], label[j]
                        if a != b:
                            label = {x: min(a, b) if v in (a, b) else v for x, v in label.items()}
            assert told == label


def test_vectors_of_other_lengths_leave_the_index_on(spark):
    import numpy as np

    from lumenfold.llm import embedding_dedup

    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24))
    x[750:] = x[:750] + 0.1 * rng.standard_normal((750, 24))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000 + k, [1.0] * (40 + k % 2), 0) for k in range(4)]
    told = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = x.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    assert sum(told[i].n_links for i in range(1500)) >= 0.98 * (near.sum() - 1500)
    assert [told[5000 + k].n_links for k in range(4)] == [1, 1, 1, 1]
    assert told[5002].component_id == 5000 and told[5003].component_id == 5001


def test_a_source_of_rows_without_ids_comes_near_its_target(spark):
    from lumenfold.llm import mixing

    rows = [(None, f"a b c {i}", "s0") for i in range(1000)] + [(7, "a b c d", "s1")] * 1000 + [(i, "a b c d", "s2") for i in range(10, 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    told = mixing.rates(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.1 * r.target for r in told), told
    assert mixing.mix(docs).count() == mixing.mix(docs).count()


def test_rows_without_ids_are_numbered_in_many_cells(spark):
    from lumenfold.llm import sharding

    rows = [(None, f"text {i}") for i in range(3000)] + [(i, "same") for i in range(100)]
    told = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    slots = defaultdict(list)
    for r in told:
        slots[r.shard].append(r.slot)
    assert len(told) == 3100 and len({r.shard for r in told if r.doc_id is None}) == 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
