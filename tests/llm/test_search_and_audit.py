"""Embedding near-duplicates, ranked search and the filter audit against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from geopressure.llm import catalog, embedding_dedup, filter_audit, ranked_search, term_matrix
from tests.llm.test_robustness import ordinary

EXTRA = "cls n node code bucket size part k digest points shard rows terms own_id least salt item score rank mask A good toxic part"


def frame(spark, rows, schema, extra=EXTRA):
    names = list(dict.fromkeys(extra.split()))
    kinds = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *names) for r in rows], f"{schema}, {kinds}")


# --- the matrix ---------------------------------------------------------------------------------------------------------


def test_entries_against_counters():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 24)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))).encode() for _ in range(200)] + [b"", b" ", b"a" * 40, b"\t\x0b\x1c b\n" * 3]
    got = term_matrix.entries(texts, term_matrix.BLANK_WORDS)
    words = got.words.to_pylist()
    assert len(set(words)) == len(words)
    for i, text in enumerate(texts):
        at = slice(got.ends[i], got.ends[i + 1])
        assert dict(zip([words[t] for t in got.terms[at]], got.counts[at].tolist(), strict=True)) == Counter(text.split())


def test_numbered_tells_apart_keys_of_one_mixed_value():
    # Keys a and b with the same mixed value: the second part undoes the first's difference.
    a, m, n = np.array([5, 9], np.uint64), np.uint64(0x9E3779B97F4A7C15), pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64)
    b0 = np.uint64(77)
    product = lambda x, y: int(x) * int(y) % (1 << 64)
    target = product(a[0], m) ^ product(a[1], 0xC2B2AE3D27D4EB4F)
    b1 = np.uint64(product(target ^ product(b0, m), n))
    number, holder = term_matrix._numbered(np.array([a, [b0, b1], a], np.uint64))
    assert number[0] == number[2] != number[1] and len(holder) == 2


def test_dictionary_is_dense_and_global(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(term_matrix, "BYTES", 20_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    built = term_matrix.build(docs)
    texts = [r.text.encode() for r in docs.collect()]
    df, total = Counter(w for t in texts for w in set(t.split())), Counter(w for t in texts for w in t.split())
    rows = built.dictionary.collect()
    assert sorted(r.term_id for r in rows) == list(range(len(df)))
    assert {bytes(r.term): (r.df, r.total) for r in rows} == {w: (df[w], total[w]) for w in df}
    names = {r.term_id: bytes(r.term) for r in rows}
    shards = built.shards.collect()
    assert len(shards) > 5
    by_id = {r.doc_id: r.text.encode() for r in docs.collect()}
    for s in shards:
        ends, terms, counts = np.frombuffer(s.ends, np.int64), np.frombuffer(s.terms, np.int32), np.frombuffer(s.counts, np.int32)
        for i, row in enumerate(s.rows):
            at = slice(ends[i], ends[i + 1])
            assert {names[s.columns[t]]: c for t, c in zip(terms[at], counts[at], strict=True)} == Counter(by_id[row.doc_id].split())


# --- the audit ----------------------------------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = (defaultdict(bool) for _ in range(2))
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    rows = []
    for i, text, source in docs:
        text = text or ""
        w = [x.decode() for x in text.encode().split()]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > first.get(text, i),
        }
        rows.append((source or "", fails, i is not None and good[i], i is not None and toxic[i]))
    out, shapley = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            every = left
            for k, f in enumerate(order):
                removed = [r for r in left if r[1][f]]
                gone = [r for r in every if r[1][f] and any(r[1][g] for g in order[:k])]
                only = [r for r in every if r[1][f] and sum(r[1].values()) == 1]
                left = [r for r in left if not r[1][f]]
                shapley[part, f] += len(removed)
                out[part, "".join(order), k + 1] = [len(left), len(removed), len(gone), len(only), sum(r[2] for r in removed), sum(r[3] for r in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in df.collect()}


def test_audit_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(term_matrix, "ROWS", 7)
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 300)}" for _ in range(260))
    docs = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in ordinary()]
    docs += [(200, long, "a"), (201, long, "b"), (201, long, "b"), (7, long + " $", "a"), (None, long, "a"), (203, long.upper(), "b"), (204, "x " * 300, "c")]
    docs += [(205, "É" * 50 + "A", "c"), (206, "#", None)]
    labels = [(200, 1, 0), (201, 0, 1), (201, 1, 0), (203, None, 1), (None, 1, 1), (204, 1, 1)]
    got = filter_audit.audit(frame(spark, docs, "doc_id long, text string, source string"), frame(spark, labels, "doc_id long, quality int, toxic int", "x y"))
    assert audited(got) == audit_by_hand(docs, labels)
    assert len(got.columns) == 10


def test_audit_builds_no_dictionary(spark, monkeypatch):
    monkeypatch.setattr(term_matrix, "_dictionary", lambda *_: pytest.fail("nothing of the audit reads it"))
    docs = [(1, "a " * 250, "s"), (2, "b # b", None)]
    got = filter_audit.audit(frame(spark, docs, "doc_id long, text string, source string"), frame(spark, [(2, 1, 1)], "doc_id long, quality int, toxic int", "x y"))
    assert audited(got) == audit_by_hand(docs, [(2, 1, 1)])


def test_audit_tells_apart_words_that_end_in_nul(spark):
    ends = ["", "\0", "\0\0"]
    words = [w + e for w in ("x", "1234567890123456", "é") for e in ends] + ["\0", "\0\0", "\0x"]
    found = term_matrix.entries([" ".join(words * 2).encode(), b"x x"], term_matrix.BLANK_WORDS)
    assert np.diff(found.ends).tolist() == [len(words), 1] and set(found.counts.tolist()) == {2}
    assert sorted(found.words.to_pylist()) == sorted(w.encode() for w in words)
    docs = [(1, " ".join(words * 2), "s"), (2, " ".join(words * 3), "s"), (3, "x x\0 x\0\0 x", None)]
    got = filter_audit.audit(frame(spark, docs, "doc_id long, text string, source string"), frame(spark, [(1, 1, 0)], "doc_id long, quality int, toxic int", "x y"))
    assert audited(got) == audit_by_hand(docs, [(1, 1, 0)])


def test_audit_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- ranked search ------------------------------------------------------------------------------------------------------


def terms_of(text):
    return bytes((text or "").encode().translate(ranked_search.TERMS)).split()


def ranked_by_hand(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // total
            weight = lambda w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))  # noqa: E731, B023
            s = sum(r * weight(w) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, r in Counter(terms_of(text)).items() if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [False, True])
def test_ranked_search_on_odd_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(term_matrix, "ROWS", 40)
    if blocks:
        monkeypatch.setattr(ranked_search, "QUERIES", 3)
        monkeypatch.setattr(ranked_search, "MAX_BROADCAST", 64)
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(60)] + ["É", "A1", "Z"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.randint(3, 63)]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(300)] + ordinary()
    docs += [(5, docs[9][1]), (400, docs[9][1]), (401, docs[9][1]), (None, docs[9][1]), (402, "!!"), (403, "x" * 200_000)]
    items = [(i, text(rng.randint(1, 25))) for i in range(12)] + [(1, docs[9][1]), (13, ""), (14, None), (15, "nowhere"), (None, docs[3][1]), (2, "T1 t1-t1_É")]
    items.append(items[0])
    index = ranked_search.build_index(frame(spark, docs, "doc_id long, text string"))
    got = ranked_search.search(index, frame(spark, items, "item_id long, text string", "item df term weight asked"), 10)
    assert sorted([tuple(r) for r in got.collect()], key=str) == ranked_by_hand(docs, items, 10)


def test_search_stops_before_the_ends_of_lists():
    rng = np.random.default_rng(2)
    words = [b"w%d" % i for i in range(400)]
    texts = [b" ".join(words[i] for i in rng.zipf(1.3, 60) % 400) for _ in range(3000)]
    texts[77] = b" ".join(words[300:330])
    found = term_matrix.entries(texts, ranked_search.TERMS)
    asked = pa.array(words[300:330], pa.binary())
    lists = ranked_search.Lists(asked, found.words, found.ends, found.terms, found.counts, len(texts), int(found.counts.sum()))
    met, direct = [], ranked_search.Lists.direct
    lists.direct = lambda *a: (met.append(len(a[2])), direct(lists, *a))[1]
    docs, scores = lists.best(np.arange(len(asked)), np.full(len(asked), 1000), 1)
    assert docs.tolist() == [77]
    assert 0 < sum(met) < len(set(lists.doc.tolist())) / 2


def test_ranked_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build_index(none), item).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ranked_search.search(ranked_search.build_index(some), item.where("false")).count() == 0


# --- embeddings ---------------------------------------------------------------------------------------------------------


def linked_by_hand(rows, threshold):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v or [])
    exact = lambda a, b: Fraction(0) if len(a) != len(b) else sum(Fraction(x) * Fraction(y) for x, y in zip(a, b, strict=True))
    n = len(rows)
    label, links = list(range(n)), [0] * n
    limit = Fraction(threshold) ** 2
    for i, j in itertools.combinations(range(n), 2):
        a, b = rows[i][1], rows[j][1]
        if ok(a) and ok(b) and len(a) == len(b):
            dot = exact(a, b)
            if dot > 0 and dot * dot >= limit * exact(a, a) * exact(b, b):
                links[i] += 1
                links[j] += 1
                x, y = label[i], label[j]
                label = [x if z == y else z for z in label]
    out = []
    for i, (ident, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        comp = min(ids, default=None)
        out.append((ident, links[i], comp, ident == comp))
    return sorted(out, key=str)


def embedded(spark, rows, kind="float", **options):
    df = frame(spark, rows, f"vec_id long, embedding array<{kind}>", "cls code bucket node h1 h2 valid linked least")
    return sorted([tuple(r) for r in embedding_dedup.near_duplicates(df, **options).collect()], key=str)


def clustered(seed, groups, size, dims, spread):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(groups):
        centre = rng.standard_normal(dims)
        for _ in range(size):
            rows.append((k, np.float32(centre + spread * rng.standard_normal(dims)).tolist()))
            k += 3
    return rows


@pytest.mark.parametrize("local", [4096, 8])
def test_embeddings_on_odd_rows(spark, monkeypatch, local):
    monkeypatch.setattr(embedding_dedup, "LOCAL", local)
    rows = clustered(4, 12, 9, 16, 0.1)
    rows += [(1, None), (2, []), (4, [0.0] * 16), (5, [float("nan")] + [1.0] * 15), (7, [None] + [1.0] * 15), (8, [float("inf")] + [1.0] * 15)]
    rows += [rows[0], (10, rows[0][1]), (None, rows[1][1]), (None, [1e-30] * 16), (11, [2.0] * 16), (0, rows[40][1]), (13, [3.0]), (14, [4.0]), (16, [-4.0]), (None, None)]
    assert embedded(spark, rows) == linked_by_hand(rows, 0.95)


def test_embeddings_of_extreme_size(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [5e-324, 0.0]), (4, [1e308, -1e308]), (5, [2.0, 2.0])]
    assert embedded(spark, rows, "double") == linked_by_hand(rows, 0.95)


def test_embeddings_of_no_rows_and_one_row(spark):
    assert embedded(spark, []) == []
    assert embedded(spark, [(3, [1.0, 2.0])]) == [(3, 0, 3, True)]
    assert embedded(spark, [(3, None)]) == [(3, 0, 3, True)]


def test_recall_near_the_threshold(spark):
    """Pairs at cosines of 0.951 to 0.96, where the tables lose most."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.951, 0.96, (1500, 1))
    y = c * x + np.sqrt(1 - c * c) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([x, y]))]
    got = {r[0]: r for r in embedded(spark, rows, "double")}
    assert sum(got[i + 1500][2] == i for i in range(1500)) >= 0.97 * 1500


def test_rotation_balances_and_approaches_bits():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2000, 24)) @ np.diag(np.linspace(3, 0.2, 24)) + 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = embedding_dedup.fit(x, 48)
    bits = embedding_dedup.code_bits(model, x, 48)
    assert bits.shape == (2000, 48) and np.abs(bits.mean(axis=0) - 0.5).max() < 0.15
    start, end = (embedding_dedup.learn_rotation(x - x.mean(axis=0), 3, rounds) for rounds in (0, 20))
    loss = lambda turn: ((np.where((v := (x - x.mean(axis=0)) @ turn) > 0, 1, -1) - v) ** 2).sum()
    assert np.allclose(end @ end.T, np.eye(24)) and loss(end) < loss(start)


def test_new_operators_are_registered():
    assert {"op11_embedding_dedup", "op12_ranked_search", "op13_filter_audit"} <= set(catalog.queries()) & set(catalog.oracle_sql())
