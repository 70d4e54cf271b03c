"""Hand-worked fixtures, one per trap, and brute-force checks of the block operators."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.functions.facts import decade, popularity_band, year_of
from refrain.functions.text import clean_tags, tokens, word_count
from refrain.operators import blocks, features as FE, pairs as P, ranking as RK, responses as RS, retrieval as R, sessions as S
from refrain.operators.fusion import fused_pool, weighted_rrf
from refrain.operators.folds import session_folds
from refrain.operators.positions import lookback, positions
from refrain.sources import artifacts, candidates as CD, catalog


def turns(spark, rows):
    return spark.createDataFrame(rows, "session_id string, user_id string, pos long, turn_number int, role string, content string")


TIE = [("s", "u", 3, 2, "music", " i2 "), ("s", "u", 0, 1, "user", "first"), ("s", "u", 2, 2, "user", "second"),
       ("s", "u", 4, 2, "assistant", "here"), ("s", "u", 1, 1, "music", "i1")]


def test_tie_turns_and_strict_history(spark):
    t = turns(spark, TIE)
    cases = S.last_requests(t)
    assert [tuple(r) for r in cases.collect()] == [("s", 2, "second")]
    assert sorted(r.content for r in S.history(t, cases).collect()) == ["first", "i1"]
    dev = {r.turn_number: (r.gt, r.n_prior_music) for r in S.dev_cases(t).collect()}
    assert dev == {1: ("i1", 0), 2: ("i2", 1)}


def test_no_plays_gives_no_source_rows(spark):
    t = turns(spark, [("s", None, 0, 1, "user", "hello")])
    assert S.plays_of(t).count() == 0 and S.dev_cases(t).count() == 0


def test_explode_turns_keeps_stored_order(spark):
    df = spark.createDataFrame([("s", [(2, "user", "b"), (1, "user", "a")])],
                               "session_id string, conversations array<struct<turn_number:int,role:string,content:string>>")
    assert [(r.pos, r.content) for r in S.explode_turns(df).orderBy("pos").collect()] == [(0, "b"), (1, "a")]


def test_positions_of_a_hot_key_cross_chunks(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    got = positions(df, ["k"], ["t"], F.floor(F.col("t") / 7), totals=True)
    assert got.where("pos <> t + 1 or pos_total <> 1000").count() == 0
    cases = spark.createDataFrame([("c", "hot", 500)], "case_id string, k string, seen long")
    rows = lookback(cases, got.select("k", "pos", "t"), "seen", "pos", 3, ["k"]).orderBy("back").collect()
    assert [r.t for r in rows] == [499, 498, 497]


def cands(spark, rows):
    return spark.createDataFrame(rows, "case_id string, source string, source_ord int, rank int, item_id string, score double")


def test_rrf_tie_keeps_first_seen_and_zero_weight_only_feeds_features(spark):
    c = cands(spark, [("c", "a", 0, 1, "z", None), ("c", "b", 1, 1, "y", None), ("c", "off", 2, 1, "q", None), ("c", "qwen_recent", 3, 2, "z", None)])
    w = {"a": 1.0, "b": 1.0, "off": 0.0, "qwen_recent": 0.0}
    assert [r.item_id for r in weighted_rrf(c, w).orderBy("pool_pos").collect()] == ["z", "y"]
    pool = {r.item_id: r.r_a for r in fused_pool(c, w).collect()}
    assert pool == {"z": 2, "y": None}


@pytest.mark.parametrize("margin,large", [(0.2499, True), (0.25, False), (1.4999, False), (1.5, True)])
def test_margin_edges(spark, margin, large):
    df = spark.createDataFrame([("c", "i", 1, margin, 1.0), ("c", "j", 2, 0.0, 2.0)], "case_id string, item_id string, pool_pos int, s_base double, s_large double")
    assert {r.used_large for r in RK.with_route(df).collect()} == {large}


def test_flat_and_nan_scores(spark):
    df = spark.createDataFrame([("c", 1.0, float("nan")), ("c", 1.0, 3.0), ("c", 1.0, 5.0)], "case_id string, a double, b double")
    rows = df.select(RK.zscore(F.col("a")).alias("za"), RK.zscore_nan(F.col("b")).alias("zb")).collect()
    assert [r.za for r in rows] == [0.0, 0.0, 0.0]
    assert sorted(round(r.zb, 6) for r in rows) == [-1.0, 0.0, 1.0]


def vectors(spark, m, prefix, col):
    return spark.createDataFrame([(f"{prefix}{i}", [float(x) for x in v]) for i, v in enumerate(m)], f"{col} string, vec array<double>")


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_dense_blocks_equal_brute_force(spark, broadcast_bytes):
    rng = np.random.default_rng(1)
    q, m = rng.normal(size=(37, 8)).round(2), rng.normal(size=(61, 8)).round(2)
    banned = {("q3", "i5"), ("q3", "i6"), ("q9", "i0")}
    ex = spark.createDataFrame(list(banned), "query_id string, item_id string")
    got = blocks.dense_topk(vectors(spark, q, "q", "query_id"), vectors(spark, m, "i", "item_id"), 5, ex,
                            broadcast_bytes=broadcast_bytes, query_block=10, item_block=9)
    want = set()
    for a in range(37):
        s = sorted((-round(float(q[a] @ m[b]), 6), f"i{b}") for b in range(61) if (f"q{a}", f"i{b}") not in banned)
        want |= {(f"q{a}", i, r + 1) for r, (_, i) in enumerate(s[:5])}
    assert {(r.query_id, r.item_id, r["rank"]) for r in got.collect()} == want


def test_short_catalog_is_a_short_list(spark):
    m = np.eye(3)
    got = blocks.dense_topk(vectors(spark, m, "q", "query_id"), vectors(spark, m, "i", "item_id"), 50)
    assert got.count() == 9


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_bm25_blocks_equal_one_block(spark, broadcast_bytes):
    words = "red blue green small large the the the ring box".split()
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(f"d{i}", " ".join(rng.choice(words, 12))) for i in range(60)], "item_id string, text string")
    asked = R.terms_of(spark.createDataFrame([("q1", "the red ring", 1), ("q1", "red", 2), ("q2", "absent", 1)], "query_id string, text string, times int"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    one = rows(R.bm25(asked, docs, 7))
    assert rows(R.bm25(asked, docs, 7, broadcast_bytes=broadcast_bytes, postings_block=90, max_docs=8)) == one
    assert len(one) == 7


def test_max_recent_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    anchors = spark.createDataFrame([("c", ["i1", "i7", "missing"])], "case_id string, anchors array<string>")
    got = [r.item_id for r in R.max_recent(anchors, vectors(spark, m, "i", "item_id"), 3, 5).orderBy("rank").collect()]
    best = sorted((-round(max(float(m[1] @ m[b]), float(m[7] @ m[b])), 6), f"i{b}") for b in range(40) if b not in (1, 7))
    assert got == [i for _, i in best[:5]]


def test_session_vector_weightings(spark):
    f = vectors(spark, np.eye(2), "i", "item_id")
    p = spark.createDataFrame([("c", "i0", 1, 2), ("c", "i1", 2, 2)], "case_id string, item_id string, pos long, pos_total long")
    old = R.session_vectors(p, f, "oldest", normalize=False).first().vec
    new = R.session_vectors(p, f, "newest", normalize=False).first().vec
    assert np.allclose(old, [1 / 1.8, 0.8 / 1.8]) and np.allclose(new, old[::-1])


def test_folds_partition_sessions_regardless_of_order(spark):
    rows = [(f"s{i}",) for i in range(53)]
    a = {r.session_id: r.fold for r in session_folds(spark.createDataFrame(rows, "session_id string")).collect()}
    b = {r.session_id: r.fold for r in session_folds(spark.createDataFrame(rows[::-1] + rows, "session_id string")).collect()}
    assert a == b and max(list(a.values()).count(f) for f in range(5)) == 11


def test_clean_tags_junk(spark):
    tags = ["80s", "1970s", "track 7", "5-star", "x" * 30, "Rock", "rock ", " a ", "Dream Pop"]
    df = spark.createDataFrame([(tags,)], "t array<string>")
    assert df.select(clean_tags(F.col("t")).alias("c")).first().c == ["80s", "1970s", "Rock", "Dream Pop"]


def test_short_refine_keeps_draft(spark):
    df = spark.createDataFrame([("d", "w " * 99), ("d", "w " * 100), ("", "w " * 100), ("d", None)], "draft string, refined string")
    got = [r.r for r in df.select(RS.refined_or_draft(F.col("draft"), F.col("refined")).alias("r")).collect()]
    assert got == ["d", "w " * 100, "", "d"]


def test_null_profile_and_scalars(spark):
    df = spark.sql("""select cast(null as struct<age_group:string,country_name:string,gender:string>) p, '2006-12-06' d, 'n/a' pop, "It's a Long song" t""")
    r = df.select(RS.profile_text(F.col("p")).alias("p"), year_of(F.col("d")).alias("y"), decade(F.col("d")).alias("dec"),
                  popularity_band(F.col("pop")).alias("b"), tokens(F.col("t")).alias("k"), word_count(F.col("t")).alias("n")).first()
    assert (r.p, r.y, r.dec, r.b, r.k, r.n) == ("", 2006, 2000, None, ["it's", "long"], 4)


def test_scalar_or_list_catalog_and_last_wins(spark):
    raw = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "track_id int, track_name string, row int")
    items = catalog.normalise(catalog.last_wins(raw, "track_id", "row"))
    assert [(r.item_id, r.track_name, r.tag_list) for r in items.collect()] == [("1", ["b"], [])]


def test_both_list_layouts_parse(spark):
    df = spark.createDataFrame([('{"lists": {"c": [{"item_id": "x", "score": 0.5}]}}',), ('{"d": [{"item_id": "y", "score": 0.1}]}',)], "v string")
    assert sorted((r.case_id, r["rank"], r.item_id) for r in CD.parse_lists(df, "v").collect()) == [("c", 1, "x"), ("d", 1, "y")]


def test_file_audit(spark, tmp_path):
    import hashlib
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"xyz")
    manifest = spark.createDataFrame([("a.bin", hashlib.sha256(b"abc").hexdigest()), ("b.bin", "0"), ("c.bin", "0")], "name string, sha256 string")
    got = {r.name: r.status for r in artifacts.audit(spark, str(tmp_path), manifest).collect()}
    assert got == {"a.bin": "OK", "b.bin": "BAD", "c.bin": "MISSING"}


def test_file_audit_in_chunks(spark, tmp_path):
    import hashlib
    contents = {"empty": b"", "short": b"abc", "even": b"x" * 40, "long": bytes(range(256)) * 5}
    folder = str(tmp_path / "out files")
    artifacts.write_files(spark.createDataFrame(list(contents.items()), "name string, content binary"), folder)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    tree = lambda b: sha(b) if len(b) <= 20 else sha("".join(sha(b[i:i + 20]) for i in range(0, len(b), 20)).encode())
    want = {sha(n.encode()): tree(b) for n, b in contents.items()}
    got = {r["name"]: r.sha for r in artifacts.hash_files_in_chunks(spark, folder, chunk_bytes=20, block=7).collect()}
    assert got == {n: d for n, d in want.items() if n != sha(b"empty")}  # Spark lists no empty files
    rows = spark.createDataFrame(list(contents.items()), "name string, content binary")
    assert {sha(r["name"].encode()): r.d for r in rows.select("name", artifacts.bytes_digest(F.col("content"), 20).alias("d")).collect()} == want
    manifest = spark.createDataFrame([(k, v) for k, v in want.items()] + [("gone", "0")], "name string, sha256 string")
    assert {r.status for r in artifacts.audit(spark, folder, manifest.where("name <> 'gone'"), 20).collect()} == {"OK"}
    assert [r.status for r in artifacts.audit(spark, folder, manifest.where("name = 'gone'"), 20).collect()] == ["MISSING"]


def test_fold_encoders_equal_encoders_fitted_without_the_fold(spark):
    texts = [("a", 0, "red blue blue sea"), ("b", 1, "red sand"), ("c", 2, "blue sky sky"), ("d", 0, ""), ("e", 1, "new words here")]
    docs = spark.createDataFrame(texts, "case_id string, fold int, text string")
    weights = R.held_out_weights(docs.select("fold", "text"), 3, width=32)
    assert weights.count() == 96
    own = {r.case_id: r.vec for r in R.held_out_encoder(docs, weights, width=32).collect()}
    all_folds = {(r.case_id, r.fold): r.vec for r in R.held_out_encoder(docs.drop("fold"), weights, width=32).collect()}
    for k in range(3):
        fitted = {r.case_id: r.vec for r in R.hashed_encoder(docs.drop("fold"), docs.where(F.col("fold") != k).select("text"), width=32).collect()}
        for case, fold, _ in texts:
            assert all_folds[case, k] == pytest.approx(fitted[case], abs=1e-12)
            assert fold != k or own[case] == pytest.approx(fitted[case], abs=1e-12)


def test_lexical_index_is_written_once(spark):
    docs = spark.createDataFrame([("a", "red red sea"), ("b", "blue sea"), ("c", None), ("d", "...")], "item_id string, text string")
    name = f"test-{uuid.uuid4().hex}"
    first = R.build_lexical_index(docs, name)
    again = R.build_lexical_index(docs.withColumn("text", F.raise_error(F.lit("read again")).cast("string")), name)
    asked = spark.createDataFrame([("q", "red", 1), ("q", "sea", 2)], "query_id string, term string, qtf int")
    assert (first.n, first.total) == (again.n, again.total) == (4, 5)
    rows = lambda index: sorted(map(tuple, R.bm25(asked, index, 3).collect()))
    assert rows(first) == rows(again) == rows(docs)


def test_history_json_matches_json_dumps(spark):
    import json
    chat = [("user", 'say "hi"\n'), ("assistant", "çà \\ ok")]
    df = spark.createDataFrame([(chat,)], "m array<struct<role:string,content:string>>")
    want = json.dumps([{"role": r, "content": c} for r, c in chat], ensure_ascii=False)
    assert df.select(RS.history_json(F.col("m")).alias("j")).first().j == want


def test_negatives_never_repeat_or_hit_positives(spark):
    items = spark.createDataFrame([(f"i{i}", [f"t{i % 30}"], ["a"], ["al"], []) for i in range(60)],
                                  "item_id string, track_name array<string>, artist_name array<string>, album_name array<string>, tag_list array<string>")
    texts = P.item_texts(items)
    batched = texts.where("item_id in ('i1', 'i2')").withColumn("batch_id", F.lit(0).cast("long"))
    neg = P.random_negatives(batched, items, 1)
    got = [r.item_text for r in neg.collect()]
    positive = {r.item_text for r in batched.collect()}
    assert len(got) == len(set(got)) == 28 and not positive & set(got)


def test_recency_counts_repeats(spark):
    p = spark.createDataFrame([("c", "x", 1, 3), ("c", "y", 2, 3), ("c", "x", 3, 3)], "case_id string, item_id string, pos long, pos_total long")
    w = {r.item_id: round(r.w, 6) for r in FE.recency_weights(p).collect()}
    assert w == {"x": 1.333333, "y": 0.5}


def test_ids_with_a_long_common_prefix_spread_over_chunks(spark):
    from refrain.operators.positions import ordinal_by_sample
    ids = spark.range(20_000).select(F.format_string("track_%08d", "id").alias("item_id"))
    got = ordinal_by_sample(ids, "item_id", "no").select("item_id", "no").collect()
    assert len(got) == 20_000 and all(int(r["item_id"][6:]) + 1 == r["no"] for r in got)
    assert ordinal_by_sample(ids.limit(0), "item_id", "no").count() == 0


def test_quantiles_with_an_outlier(spark):
    from refrain.operators.weighting import quantiles, value_counts
    df = spark.range(1001).select(F.when(F.col("id") == 1000, F.lit(1e18)).otherwise(F.col("id").cast("double")).alias("v"))
    r = quantiles(df, "v", [0.5, 0.9]).first()
    assert (r["q5"], r["q9"]) == (500.0, 900.0)
    assert value_counts(df, "v", {"n": F.count("*")}).agg(F.max("c_n")).first()[0] == 1001


def test_no_gold_play_in_its_history(spark):
    from workload import tables as T
    sf = "/root/testdata/sf0.001"
    last = T.all_plays(spark, sf).where("pos = pos_total").select("case_id", "pos")
    assert T.plays(spark, sf).join(last, ["case_id", "pos"]).count() == 0
    assert T.gold(spark, sf).count() == last.count()


def test_missing_fold_fails_loudly(spark):
    from refrain.operators.retrieval import stack_folds
    rows = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0]), ("b", 0, [3.0])], "item_id string, fold int, vec array<double>")
    assert stack_folds(rows.where("item_id = 'a'"), "item_id", 2).first()["vec"] == [1.0, 2.0]
    with pytest.raises(Exception, match="not all 2 folds"):
        stack_folds(rows, "item_id", 2).collect()


def test_clean_tags_makes_its_lists_once_a_row(spark):
    df = spark.createDataFrame([(["Rock", "rock", "ROCK", "jazz"],)], "t array<string>").select(clean_tags(F.col("t")).alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("star") == 1 and df.first().c == ["Rock", "jazz"]
