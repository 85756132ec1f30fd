"""Links and components of planted vectors against brute force."""

import numpy as np
import pytest

from lumenfold.llm import embedding_dedup as E


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def beside(rng, x, cosine):
    """A vector at this cosine from x, in a random direction."""
    off = rng.standard_normal(x.shape)
    off = unit(off - (off * x).sum(axis=-1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * off


def smallest_reached(near):
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        if (low == label).all():
            return label
        label = low


def test_chains_are_one_component(spark):
    """Neighbours at 0.95 are linked, their ends are not; ids are dealt out at random, so no row names all partners."""
    rng = np.random.default_rng(0)
    chains = []
    for _ in range(15):
        chains.append(unit(rng.standard_normal(64)))
        for _ in range(7):
            chains.append(beside(rng, chains[-1], 0.95))
    x = np.array(chains)[rng.permutation(len(chains))]
    near = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    told = {r.vec_id: r for r in E.embedding_dedup(rows).collect()}
    assert [told[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [told[i].component_id for i in range(len(x))] == smallest_reached(near).tolist()


def test_chain_within_a_block():
    """Links 1-3, 3-4, 4-2: no row's smallest partner is the link 3-4."""
    near = np.zeros((5, 5), bool)
    for a, b in ((1, 3), (3, 4), (4, 2)):
        near[a, b] = near[b, a] = True
    assert E.joined(near, np.arange(5)).tolist() == [0, 1, 1, 1, 1]
    assert E.joined(near, np.array([9, 7, 8, 5, 6])).tolist() == [9, 5, 5, 5, 5]


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize(("shift", "planned"), [(0, None), (1.5, None), (3, None), (1, (8, 1, 6)), (1, (8, 0, 24))])
def test_recall_where_vectors_share_a_direction(spark, shift, planned):
    """Links just over the threshold; a common direction widens their angle after centring. Two plans are fixed: one that
    probes neighbouring keys, one that doesn't."""
    rng = np.random.default_rng(2)
    mean = unit(rng.standard_normal(64))
    x = unit(shift * mean + rng.standard_normal((800, 64)) / 8)
    x = np.concatenate([x, beside(rng, x, 0.932)])
    near = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    told = {r.vec_id: r for r in E.embedding_dedup(frame(spark, x), planned=planned).collect()}
    links = np.array([told[i].n_links for i in range(len(x))])
    assert (links <= near.sum(axis=1)).all()
    assert links.sum() >= 0.985 * near.sum()
    assert planned or told[0].index_recall >= 0.99


def test_buckets_of_many_blocks(spark, monkeypatch):
    """One dense group in one bucket, dealt out as pairs of blocks, with guests from neighbouring keys."""
    monkeypatch.setattr(E, "BLOCK", 8)
    rng = np.random.default_rng(4)
    x = np.concatenate([unit(unit(rng.standard_normal(16)) + 0.09 * rng.standard_normal((90, 16))), unit(rng.standard_normal((30, 16)))])
    near = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    for planned in ((0, 0, 1), (4, 1, 24)):
        told = {r.vec_id: r for r in E.embedding_dedup(frame(spark, x), planned=planned).collect()}
        links = np.array([told[i].n_links for i in range(len(x))])
        assert (links <= near.sum(axis=1)).all() and links.sum() >= (1 if planned[0] == 0 else 0.99) * near.sum()
        assert [told[i].component_id for i in range(len(x))] == smallest_reached(near).tolist() or planned[0]


def test_all_pairs_where_no_tables_pay():
    """Rows so close to the centre that a pair's angle there says little: one table, where all rows of a label meet."""
    rng = np.random.default_rng(1)
    x = unit(unit(rng.standard_normal(64)) + 0.15 * rng.standard_normal((400, 64)) / 8)
    assert E.plan(E.Coder(x, 64), 2000, 0.93)[:3] == (0, 0, 1)


def test_bits_are_balanced():
    rng = np.random.default_rng(1)
    x = unit(0.7 + rng.standard_normal((1000, 32)) * np.linspace(0.1, 2, 32))
    coder = E.Coder(x, 32)
    coder.grow(2)
    share = coder.bits(x).mean(axis=0)
    assert share.shape == (64,) and abs(share - 0.5).max() < 0.01


def test_equal_vectors_null_and_repeated_ids(spark):
    """Classes of equal vectors count each row; ids that are null or shared change nothing for the others."""
    a, b, far = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a, 1), (5, far, 1), (None, a, 1), (3, b, 1), (3, b, 1), (9, a, 2), (8, a, None), (7, [], 1), (6, [float("inf")] * 3, 1)]
    told = E.embedding_dedup(spark.createDataFrame([(*r, 0) for r in rows], "vec_id int, embedding array<float>, label int, row int")).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in told), key=str)
    want = [(5, 3, 3, False), (5, 0, 5, True), (None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (9, 0, 9, True), (8, 0, 8, True), (7, 0, 7, True), (6, 0, 6, True)]
    assert got == sorted(want, key=str)


def test_a_vector_that_half_of_all_rows_share(spark):
    rows = spark.range(4000).selectExpr("id AS vec_id", "1 AS label", "if(id % 2 = 0, array(1.0D, 2.0D), array(cos(id), sin(id))) AS embedding")
    told = {r.vec_id: r for r in E.embedding_dedup(rows).collect()}
    x = np.array([[1, 2] if i % 2 == 0 else [np.cos(i), np.sin(i)] for i in range(4000)])
    near = unit(x.astype(float)) @ unit(x.astype(float)).T >= 0.93
    links = np.array([told[i].n_links for i in range(4000)])
    assert links.sum() >= 0.99 * (near.sum() - 4000) and told[0].n_links >= 1999
