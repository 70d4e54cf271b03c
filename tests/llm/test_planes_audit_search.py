"""Token files, source divergence and lexical search against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import LOW
from pyspark.sql import functions as F
from test_corpus import docs, none, rows, run  # noqa: F401  (fixtures)
from tokenizers import Tokenizer

from refrain.llm import lexical_search, source_audit, token_planes

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---- token files -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def encoded(rows, tokenizer):  # noqa: F811
    """Ids of every row with the end id, in the order of the files (equal ids hold equal texts here)."""
    out = []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((r[0], np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4")))
    return out


def want_documents(encoded):
    start, out = 0, []
    for doc_id, ids in encoded:
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return Counter(out)


def test_token_files(monkeypatch, spark, docs, encoded):  # noqa: F811
    got = run(monkeypatch, spark, "op11_token_planes", documents=docs)
    assert Counter((g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) for g in got) == want_documents(encoded)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_documents_that_span_chunks(docs, encoded, planes):  # noqa: F811
    stored = token_planes.write(docs, WORD_BPE, chunk=64, planes=planes)
    assert Counter(map(tuple, token_planes.read(stored).collect())) == want_documents(encoded)
    index = stored.select("part", "chunk", "first", "n").orderBy("part", "chunk").collect()
    assert all(r["first"] == 64 * r["chunk"] for r in index) and sum(r["n"] for r in index) == sum(len(i) for _, i in encoded)
    every = np.concatenate([i for _, i in encoded])
    for start, n in ((0, 10), (100, 1000), (len(every) - 5, 50)):
        runs = sorted(map(tuple, token_planes.window(stored, start, n).collect()))
        assert runs[0][0] == start and [x for _, ids in runs for x in ids] == every[start:start + n].tolist()


def test_blocks_round_trip_and_damage_shows(spark, docs):  # noqa: F811
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        for planes in token_planes.KINDS:
            ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
            assert (token_planes.unpack(token_planes.pack(ids, planes)) == ids).all()
    stored = token_planes.write(docs.limit(3), WORD_BPE).withColumn("crc32", F.col("crc32") + 1)
    with pytest.raises(Exception, match="damaged"):
        token_planes.read(stored).collect()


def test_checksums_join():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randrange(50))) for _ in "ab")
        assert token_planes.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_words_by_themselves_give_the_texts_ids(monkeypatch, tokenizer):
    monkeypatch.setattr(token_planes, "REMEMBERED", 40)
    monkeypatch.setattr(token_planes, "STRETCH", 8)
    words, rng = token_planes.Words(tokenizer), random.Random(3)
    bits = ["the", "ing", " ", "  ", "\n", "\t", "\r\n", "É", "ß", "İ", "Σ", "中文", "👩‍👩‍👧", "\x1c", "\x85", "\xa0", " ", "　", "'s", "12", "zz", "ق", "́", "<|", "e", "!!", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "İ,", "ŉ.", "é!", "क़,", "I", "̇", "A", "Z.", "k)"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert np.frombuffer(words.text(t.encode()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


# ---- divergence of sources ---------------------------------------------------------------

def audit_by_hand(rows, least, top=50):
    texts = [(x or "", s or "", LETTERS.findall((t or "").translate(LOW))) for t, x, s in rows]
    in_docs, count = defaultdict(Counter), defaultdict(Counter)
    for x, _, ws in texts:
        in_docs[x].update(set(ws))
    kept = {x: sorted((t for t, n in c.items() if n >= least), key=str.encode) for x, c in in_docs.items()}
    for x, s, ws in texts:
        known = set(kept[x])
        count[x, s].update(w for w in ws if w in known)
    out = []
    share = lambda c, terms: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(terms)) for t in terms}
    p = {g: share(c, kept[g[0]]) for g, c in count.items()}
    for x, s in count:
        pairs = [(sum(abs(p[x, s][t] - p[g][t]) for t in kept[x]), g[1]) for g in count if g[0] == x and g[1] != s]
        q = share(sum((c for g, c in count.items() if g[0] == x), Counter()), kept[x])
        terms = [(p[x, s][t] - q[t], t) for t in kept[x] if count[x, s][t] and p[x, s][t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda v: (-v[0], v[1].encode()))
            out += [(x, s, part, item, value, r) for r, (value, item) in enumerate(found, 1) if part == "pair" or r <= top]
    return Counter(out)


def tuples(df):
    return Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("shard_terms, sent_bytes, tile", [(100_000, 64 << 20, (128, 4096)), (7, 1, (2, 16))])
def test_source_audit(monkeypatch, docs, rows, shard_terms, sent_bytes, tile):  # noqa: F811
    monkeypatch.setattr(source_audit, "TILE_SOURCES", tile[0])
    monkeypatch.setattr(source_audit, "TILE_TERMS", tile[1])
    lang = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 7 < 5, F.lit("en")).otherwise(F.lit("é"))
    given = docs.withColumn("lang", lang).withColumn("ord", F.lit("x")).withColumn("shard", F.lit(1))
    of = lambda i: "" if i is None else "" if i % 7 == 0 else "en" if i % 7 < 5 else "é"
    # a null id's language comes out of the last branch
    want = audit_by_hand([(r[1], "é" if r[0] is None else of(r[0]), r[2]) for r in rows], 3, 5)
    got = tuples(source_audit.audit(given, least_docs=3, top=5, shard_terms=shard_terms, sent_bytes=sent_bytes))
    assert got == want and {k[2] for k in got} == {"pair", "term"}


def test_source_audit_without_kept_terms(docs):  # noqa: F811
    got = source_audit.audit(docs.withColumn("lang", F.lit("en")), least_docs=10**6).collect()
    assert got and all((r["part"], r["value"]) == ("pair", 0) for r in got)


def test_source_audit_of_nothing(monkeypatch, spark, none):  # noqa: F811
    assert run(monkeypatch, spark, "op12_source_audit", documents=none.withColumn("lang", F.lit("x"))) == []
    assert run(monkeypatch, spark, "op11_token_planes", documents=none) == []


def test_shares_are_exact():
    rng = random.Random(4)
    for _ in range(2000):
        total = rng.choice([0, 7, 10**6, 10**13, 1 << 60])
        n, terms = rng.randrange(total + 1), rng.randrange(1, 10**6)
        assert source_audit.shares(np.array([n]), total, terms)[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_transducer_counts_through():
    rng = random.Random(5)
    for size in (1, 2, 50, 3000):
        terms = sorted({"".join(rng.choice("abcdéß中") for _ in range(rng.randrange(1, 9))).encode() for _ in range(size)})
        table = source_audit.Transducer.build(terms)
        assert [table.term(i) for i in range(len(terms))] == terms
        asked = terms + [t + b"a" for t in terms] + [t[:-1] + b"z" for t in terms] + [b"zz" * 20]
        rng.shuffle(asked)
        octets = np.frombuffer(b" ".join([*asked, b""]), np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 for t in asked[:-1])])
        which, number = table.ordinals(octets, starts)
        place = {t: i for i, t in enumerate(terms)}
        assert dict(zip(which.tolist(), number.tolist())) == {i: place[t] for i, t in enumerate(asked) if t in place}
        back = source_audit.Transducer.unpacked(table.packed())
        assert (back.check == table.check).all() and (back.final == table.final).all()
    # equal endings share their states
    assert len(source_audit.Transducer.build(sorted(f"{a}{b}ing".encode() for a in "abc" for b in "xyz")).final) == 6


# ---- lexical search ------------------------------------------------------------------------

def search_by_hand(texts, items, k):
    found = [(i, TERMS.findall((t or "").translate(LOW))) for i, t in texts]
    found = [(i, Counter(ws), len(ws)) for i, ws in found if ws]
    n_docs, n_terms = len(found), sum(n for *_, n in found)
    df = Counter(w for _, c, _ in found for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in found:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(TERMS.findall((text or "").translate(LOW))) if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


ITEMS = [(1, "the of w1 W2 w3 token 1"), (1, "the of w1 W2 w3 token 1"), (2, None), (3, "nowhere"), (4, "É é 日本 w7 w8 w9 w10 w11 w12"), (None, "mit license"),
         (5, "the the the"), (6, " ".join(f"w{i}" for i in range(300))), (7, "")]


@pytest.mark.parametrize("block, sent_bytes, k", [(1_500_000, 32 << 20, 10), (60, 900, 3)])
def test_lexical_search(monkeypatch, spark, docs, rows, block, sent_bytes, k):  # noqa: F811
    monkeypatch.setattr(lexical_search, "ROWS", 5)
    monkeypatch.setattr(lexical_search, "DEPTH", 2)
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, term string")
    got = lexical_search.search(docs, items, k, block=block, sent_bytes=sent_bytes).select("item_id", "rank", "doc_id", "score")
    assert Counter(map(tuple, got.collect())) == search_by_hand([r[:2] for r in rows], ITEMS, k)


def test_lexical_search_of_nothing(monkeypatch, spark, docs, none):  # noqa: F811
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert run(monkeypatch, spark, "op13_lexical_search", documents=none, benchmark=items) == []
    assert run(monkeypatch, spark, "op13_lexical_search", documents=docs, benchmark=items.limit(0)) == []


def test_best_positions_stop_early_and_keep_ties():
    rng = np.random.default_rng(6)
    n, terms = 20_000, 4
    tfs = rng.geometric(0.5, (n, terms))
    tfs[:12] = 400  # twelve documents tie at the top
    block = lexical_search.Block(np.full(n, terms), np.tile(np.arange(terms), n), tfs.ravel().astype(np.int64), np.full(n, 100))
    weights = np.array([5, 3, 2, 0])
    docs, scores, scored = block.best(np.arange(terms), weights, -1, 10)  # noqa: F811
    impact = 10**9 * tfs // (1000 * tfs + 800)
    every = impact @ weights
    assert sorted(docs.tolist()) == list(range(12)) and (scores == every[:12]).all() and scored < 2000
    docs, scores, scored = block.best(np.arange(terms), weights, int(every.max()) + 1, 10)
    assert not len(docs) and scored < 2000
