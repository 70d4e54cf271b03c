"""Long runs, large tiles and the classifier's parts against plain Python."""

import math
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from refrain.llm import pii, topk_tiles, toxicity


def test_accounts_read_in_linear_time():
    anchors = pii._anchors()
    for piece in ("IBAN A ", "iban A1-", "account 1 2 ", "account number ", "+1 ", "a@", "1.", "iban ... ", "://u:p"):
        spent = []
        for n in (1 << 17, 1 << 20):
            text = (piece * (n // len(piece) + 1))[:n]
            start = time.time()
            pii.find_spans(text, anchors)
            spent.append(time.time() - start)
        assert spent[1] < 30 and spent[1] < 24 * spent[0] + 1, (piece, spent)


def test_account_cues_with_any_number_of_marks():
    anchors = pii._anchors()
    for gap in (" ", ": ", " ." * 20, " " * 13, " " * 14, "-" * 500):
        text = f"account{gap}12345678 end"
        assert [s for s in pii.find_spans(text, anchors) if s[0] == "account"] == [("account", 7 + len(gap), 15 + len(gap))]
    assert not [s for s in pii.find_spans("account " + "1" * 21, anchors) if s[0] == "account"]
    assert not [s for s in pii.find_spans("account 123456" + "a" * 29, anchors) if s[0] == "account"]


def test_pieces_of_a_tile_give_the_same_lists():
    rng = np.random.default_rng(1)
    q_ids, ids = np.repeat(np.arange(0, 600, 2), 2), np.sort(rng.integers(0, 900, 1500))
    q, v = rng.integers(-3, 4, (len(q_ids), 5)).astype(float), rng.integers(-3, 4, (len(ids), 5)).astype(float)
    got = [tuple(map(int, t)) for t in zip(*topk_tiles.best_of_pair(q_ids, q, ids, v, 4, products_at_once=1000))]
    want = []
    for one in np.unique(q_ids):
        best = {}
        for a in np.flatnonzero(q_ids == one):
            for b, score in enumerate((q[a] @ v.T).astype(int)):
                if ids[b] != one:
                    best[int(ids[b])] = max(score, best.get(int(ids[b]), -10**9))
        want += [(int(one), i, int(s)) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4]]
    assert got == want


def grams(text, bits=toxicity.BITS):
    t = f" {text} ".translate({c: c + 32 for c in range(65, 91)})
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(t) - n + 1):
            h = n
            for c in t[i:i + n]:
                h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
            out.add((h * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits))
    return out


def test_buckets_and_scores_by_hand():
    rng = random.Random(2)
    model = toxicity.Model(np.array([rng.uniform(-1, 1) for _ in range(1 << 10)]), np.array([rng.random() for _ in range(1 << 10)]), 0.3, 1.7, -0.2, 10)
    for text in ("", "a", "Some WORDS here", "é" * 50, "".join(chr(rng.randrange(32, 3000)) for _ in range(5000))):
        assert set(toxicity.buckets(text).tolist()) == grams(text)
        at = grams(text, 10)
        margin = sum(model.weighted[i] for i in at) / math.sqrt(sum(model.squares[i] for i in at) + 1e-9) + 0.3
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-(1.7 * margin - 0.2))), rel_tol=1e-9)


def test_counts_and_ratios_by_hand(monkeypatch, spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["one", "two", "moron", "four", "é"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    marks = [(i, int("moron" in t)) for i, t in rows]
    real = toxicity.log_ratios
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    fold = {r[0]: r[1] for r in docs.select("doc_id", toxicity._fold()).collect()}
    count = {(k, y): Counter() for k in range(2) for y in range(2)}
    n = Counter()
    for (i, t), (_, y) in zip(rows, marks):
        count[fold[i], y].update(grams(t, 12))
        n[fold[i], y] += 1
    got = (toxicity.labelled(docs, labels).select("text", "toxic", "fold").mapInArrow(toxicity._counter(12), "cell long, n long")
           .groupBy("cell").agg(F.sum("n").alias("n")).collect())
    want = {(k * 2 + y) * 4096 + b: c for (k, y), cs in count.items() for b, c in cs.items()} | {16384 + k * 2 + y: c for (k, y), c in n.items()}
    assert {r["cell"]: r["n"] for r in got} == want
    pos, neg = (np.array([count[0, y][b] + count[1, y][b] for b in range(4096)], dtype=float) for y in (1, 0))
    p, m = sum(y for _, y in marks), sum(1 - y for _, y in marks)
    ratio = real(pos, neg, p, m)
    for b in range(0, 4096, 97):
        a0, a1 = 5 * m / 60, 5 * p / 60
        assert math.isclose(ratio[b], math.log((pos[b] + a1) / (p + a1)) - math.log((neg[b] + a0) / (m + a0)), abs_tol=1e-12)


def test_sample_takes_one_text_an_id(spark):
    rows = [(i, f"text {i}", i % 2, 0) for i in range(100)] + [(7, "aaa", 1, 0)] * 500
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int")
    got = toxicity._sample(table, 20, 600).collect()
    order = [r[0] for r in spark.range(100).select("id", F.shiftrightunsigned(F.xxhash64(F.lit(11), "id"), 1).alias("h")).orderBy("h", "id").limit(20).collect()]
    assert sorted(r["text"] for r in got) == sorted("aaa" if i == 7 else f"text {i}" for i in order)


def test_top_k_gathers_no_tiles_on_the_driver(spark):
    """Tiles come once a shard; before, all those copies were one broadcast as soon as the vectors themselves looked small."""
    from refrain.llm import topk_tiles
    vectors = spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda d: F.pmod(F.xxhash64("id", d), F.lit(100)) / 100.0).alias("embedding"))
    lists = topk_tiles.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5, shard_bytes=1 << 12)
    assert len(lists.collect()) == 60 * 5
    assert "Broadcast" not in lists._jdf.queryExecution().executedPlan().toString()
