"""Near copies are proposed by fingerprints and checked on their texts."""

import random

import brute
import numpy as np

from refrain.llm import near_copies, simhash


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(out)


def test_near_copies_are_found_and_others_stay(monkeypatch, spark):
    rng = random.Random(5)
    bases = [[rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(rng.randrange(60, 400))] for _ in range(60)]
    texts = [edited(rng, b, n) for b in bases for n in (0, len(b) // 60, len(b) // 45, len(b) // 15, len(b) // 8)] + ["", "one", "one two", None, "", "One"]
    sets = [shingles(t or "") for t in texts]
    keys = list(range(len(texts)))
    roots = brute.components(set(keys), lambda a, b: similar(sets[a], sets[b]))
    pairs = [(a, b) for a in keys for b in keys[:a] if similar(sets[a], sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for small in (near_copies.SMALL_BLOCK, 6000):
        monkeypatch.setattr(near_copies, "SMALL_BLOCK", small)
        kept = {r["doc_id"] for r in near_copies.drop(docs).collect()}
        assert len(pairs) > 100 and sum(a in kept and b in kept for a, b in pairs) <= 0.05 * len(pairs)  # recall of links: 0.95 and more
        least = {}
        for k in keys:
            least[roots[k]] = min(k, least.get(roots[k], k))
        assert all(k in kept for k in keys if least[roots[k]] == k)  # what has no lesser copy stays


def forms(rng, base, steps):
    """A chain of sets, each near the one before, whose ends lie apart."""
    out, now = [], list(base)
    for k in range(steps):
        now = now[4:] + [rng.randrange(1 << 40) for _ in range(4)]
        out.append(list(now))
    return out


def test_large_components_keep_every_link(monkeypatch, spark):
    rng = random.Random(11)
    new = lambda n: [rng.randrange(1 << 40) for _ in range(n)]
    hub, other = new(60), new(60)
    sets = [hub[k % 5:] + new(k % 5) for k in range(150)] + forms(rng, hub, 40) + [other[k % 4:] + new(k % 4) for k in range(60)]
    sets += forms(rng, other, 12) + [new(rng.randrange(1, 90)) for _ in range(30)] + [new(20000)] + [new(3), [7], [7], [7, 8]]
    rng.shuffle(sets)
    parts = [3 if k % 7 else 4 for k in range(len(sets))]  # two proposed components, which must not link
    rows = spark.createDataFrame([(k, p, s) for k, (p, s) in enumerate(zip(parts, sets))], "row long, part_of long, shingles array<long>")
    keys, have = set(range(len(sets))), [set(s) for s in sets]
    want = brute.components(keys, lambda a, b: parts[a] == parts[b] and similar(have[a], have[b]))
    assert len(set(want.values())) > 30
    for small, large in ((1 << 18, 1 << 22), (2000, 4000), (20000, 20000)):
        monkeypatch.setattr(near_copies, "SMALL_BLOCK", small)
        monkeypatch.setattr(near_copies, "LARGE_BLOCK", large)
        edges = [(r["u"], r["v"]) for r in near_copies.links(rows).collect()]
        assert all(u > v and parts[u] == parts[v] and similar(have[u], have[v]) for u, v in edges)
        joined = set(edges) | {(v, u) for u, v in edges}
        got = brute.components(keys, lambda a, b: (a, b) in joined)
        groups = lambda f: sorted(sorted(x for x in keys if f[x] == g) for g in set(f.values()))
        assert groups(got) == groups(want)


def test_a_group_of_copies_costs_about_its_size(monkeypatch, spark):
    rng = random.Random(12)
    hub = [rng.randrange(1 << 40) for _ in range(60)]
    rows = spark.createDataFrame([(k, 0, hub[k % 4:] + [rng.randrange(1 << 40) for _ in range(k % 4)]) for k in range(600)], "row long, part_of long, shingles array<long>")
    monkeypatch.setattr(near_copies, "SMALL_BLOCK", 6000)
    monkeypatch.setattr(near_copies, "LARGE_BLOCK", 6000)
    met = []
    kept = near_copies._linked
    monkeypatch.setattr(near_copies, "_linked", lambda packs: met.append(packs.count()) or kept(packs))
    edges = near_copies.links(rows).distinct().collect()
    assert len({e for r in edges for e in r}) == 600
    assert met[0] > 40 and met[1] == 0  # blocks meet the pivots; none meets another block


def test_columns_of_any_name_and_repeated_rows(spark):
    rows = [(1, "a b c d e f", "x", 5, 0.5), (1, "a b c d e f", "x", 5, 0.5), (None, "a b c d e f", "y", 6, 0.1), (2, "other words stand here", "z", 7, 0.2), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, u int, row double")
    got = near_copies.drop(docs)
    assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(map(repr, [docs.collect()[i] for i in (0, 3, 4)]))
    import corpus_pipeline
    got = corpus_pipeline.drop_copies(spark, docs, "")
    assert got.columns == docs.columns and sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, [rows[0], rows[3], rows[4]]))
    assert near_copies.drop(docs.limit(0)).count() == corpus_pipeline.drop_copies(spark, docs.limit(0), "").count() == 0


def test_masks_are_wide_and_cover():
    rng = random.Random(4)
    for radius in (3, 4, 5, 6):
        masks = [m % (1 << 64) for m in simhash.masks(radius)]
        assert min(m.bit_count() for m in masks) >= 28
        for _ in range(500):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(diff & m == 0 for m in masks)


def test_a_bucket_of_many_blocks_keeps_its_links(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    far = {base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False)) for _ in range(300)} | {base}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in far]
    edges = simhash.linked(spark.createDataFrame(signed, "fp long"), block=16)
    got = {r["u"] % (1 << 64): r["root"] for r in simhash.components(edges).collect()}
    want = brute.components(far, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = lambda f: sorted(sorted(x for x in far if f(x) == g) for g in {f(x) for x in far})
    assert groups(lambda x: got.get(x, x - (1 << 64) if x >> 63 else x)) == groups(lambda x: want[x])


def test_edges_of_many_forests_go_on_as_one(monkeypatch, spark):
    rng = random.Random(8)
    n, trees = 400, []
    for _ in range(31):  # as covering tables find a group: each table another tree over the same nodes
        order = rng.sample(range(n), n)
        trees += [(order[k], order[rng.randrange(k)]) for k in range(1, n)]
    edges = [(max(e), min(e)) for e in trees] + [(n + k, n + k - 1) for k in range(2, 50)] + [(7, 7)]
    stepped, kept = [], simhash.stage

    def stage(df, name):
        out = kept(df, name)
        stepped.append((name, out.count()))
        return out

    monkeypatch.setattr(simhash, "stage", stage)
    got = simhash.components(spark.createDataFrame(edges, "u long, v long").repartition(9)).collect()
    assert sorted(map(tuple, got)) == [(k, 0) for k in range(1, n)] + [(n + k, n + 1) for k in range(2, 50)]
    rows = [k for name, k in stepped if name == "simhash-stars"]
    assert max(rows) <= len(got) and sum(rows) <= 3 * len(got)


def test_edges_are_contracted_in_bounded_chunks(spark):
    rng = random.Random(9)
    edges = [(max(e), min(e)) for e in ((rng.randrange(2000), rng.randrange(2000)) for _ in range(2200))]

    def least(pairs):
        label = list(range(2000))
        while True:
            before = list(label)
            for u, v in pairs:
                label[u] = label[v] = min(label[u], label[v])
            if label == before:
                return label

    table = simhash.stage(spark.createDataFrame(edges, "u long, v long").repartition(3), "test-edges")
    for chunk in (64, 1 << 19):  # some chunks are full of stars and go on before the task ends
        got = [tuple(r) for r in simhash.contracted(table, chunk).collect()]
        assert all(u > v for u, v in got) and least(got) == least(edges)
