"""Recall of the candidate search, and groups that no single node or task may finish at once."""

import math
import random

import numpy as np
import pytest

from geopressure.llm import near_dedup


def test_sketch_filter_keeps_pairs_at_the_threshold():
    n, p = near_dedup.COORDS, 0.15
    missed = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(near_dedup.sketch_reach(0.8) + 1, n + 1))
    assert missed < 2e-5


def pairs_at(similarity: float, n: int) -> list[tuple[int, str]]:
    """n pairs of texts of one-word shingles whose sets have about the similarity, shingles of no other pair but a common one."""
    own = round(46 * (1 - similarity) / (1 + similarity))
    rows = []
    for i in range(n):
        same = ["common", *[f"w{i}x{k}" for k in range(46 - own)]]
        rows += [(2 * i + j, " ".join(same + [f"w{i}y{j}{k}" for k in range(own)])) for j in range(2)]
    return rows


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.95])
def test_recall_by_band_through_branches(spark, monkeypatch, similarity):
    """Pairs of one band; every node of more than 16 members is left to its child nodes."""
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    rows = pairs_at(similarity, 1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, width=1, local=16, max_depth=6)
    lost = [r.doc_id for r in found.where("doc_id % 2 = 1").collect() if r.component_id != r.doc_id - 1]
    assert lost == []


def loose_group(n: int) -> list[str]:
    """Texts made from one by changing up to a third of its words: some linked with many, some with none."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    out = []
    for i in range(n):
        words = list(base)
        for k in rng.sample(range(60), rng.choice((0, 2, 3, 5, 8, 12, 20))):
            words[k] = f"c{rng.randrange(40)}" if rng.random() < 0.5 else f"d{i}k{k}"
        out.append(" ".join(words))
    return out


def brute_components(texts: list[str], width: int) -> list[int]:
    words = near_dedup.WordHash()
    sets = [near_dedup.shingle_set(t, words, width) for t in texts]
    names = {g: k for k, g in enumerate(sorted({int(g) for s in sets for g in s}))}
    held = np.zeros((len(texts), len(names)), np.float32)
    for i, s in enumerate(sets):
        held[i, [names[int(g)] for g in s]] = 1
    inter, size = held @ held.T, held.sum(axis=1)
    linked = inter * 100 >= (size[:, None] + size[None] - inter) * 80
    label = np.arange(len(texts))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("local", [near_dedup.LOCAL, 300])
def test_loose_group_of_2600_equals_brute_force(spark, local):
    texts = loose_group(2600)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, local=local).select("doc_id", "component_id").collect()
    assert [c for _, c in sorted(map(tuple, got))] == brute_components(texts, 2)


def test_links_of_a_list_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 50, np.uint64)
    sets = []
    for _ in range(200):
        keep = base[rng.random(50) < rng.choice([1.0, 0.95, 0.85])]
        sets.append(np.unique(np.append(keep, rng.integers(0, 300, rng.integers(1, 6)).astype(np.uint64))))
    label = np.arange(200)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            inter = len(np.intersect1d(a, b))
            if inter * 100 >= (len(a) + len(b) - inter) * 80:
                label[label == label[i]] = label[j]
    want = sorted(sorted(np.flatnonzero(label == k).tolist()) for k in set(label.tolist()) if (label == k).sum() > 1)
    assert sorted(sorted(s.tolist()) for s in near_dedup.link_sets(sets, 80, 100).sets()) == want


def test_a_list_of_many_shingles_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ELEMENTS", 400)
    texts = loose_group(120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).select("doc_id", "component_id").collect()
    assert [c for _, c in sorted(map(tuple, got))] == brute_components(texts, 2)
