"""The pipeline's stages, one by one and together, against brute force."""

import random
from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest

import corpus_pipeline
from refrain.llm import bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = "the of and to in is on by at as it or an be".split() + [f"v{i}" for i in range(400)]
    out = []
    for i in range(160):
        w = [rng.choice(words) for _ in range(rng.randrange(40, 120))]
        if i % 5 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]))
        out.append((i, " ".join(w), "en", f"s{i % 3 if i % 2 else 0}", 0))
    out += [(200 + k, out[1][1].upper(), "en", "s1", 0) for k in range(3)]
    out += [(300, out[3][1] + " tail", None, None, None), (301, "", "en", "s2", 0), (302, None, "en", "s2", 0), (303, "short one", "en", "s0", 0)]
    return out


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    marks = [(r[0], 0, int(r[0] < 160 and r[0] % 5 == 0)) for r in rows if r[0] % 4]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def tuples(df):
    return [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, sf), "test")
        out.append(docs)
    return out


def test_columns_stay(stages, spark, sf):
    want = spark.read.parquet(f"{sf}/documents.parquet").dtypes
    assert all(df.dtypes == want for df in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mix", "byte bpe"]


def test_toxic_documents_go_and_others_stay(stages, rows):
    kept = {r[0] for r in tuples(stages[0])}
    toxic = {r[0] for r in rows if r[0] < 160 and r[0] % 5 == 0}
    assert len(kept & toxic) <= 3 and len({r[0] for r in rows} - toxic - kept) <= 1


def test_exact_copies(stages):
    before, after = tuples(stages[0]), Counter(tuples(stages[1]))
    keep = {r[0] for r in brute.exact([r[:2] for r in before]) if r[3]}
    assert after == Counter(r for r in before if r[0] in keep)


def test_near_copies(stages):
    from test_near_copies import shingles, similar
    before, after = tuples(stages[1]), Counter(tuples(stages[2]))
    sets = {r[0]: shingles(r[1] or "") for r in before}
    roots, least = brute.components(set(sets), lambda a, b: similar(sets[a], sets[b])), {}
    for i in sets:
        least[roots[i]] = min(i, least.get(roots[i], i))
    assert after == Counter(r for r in before if least[roots[r[0]]] == r[0])


def test_mix(stages):
    before, after = tuples(stages[2]), Counter(tuples(stages[3]))
    size = {r[0]: len(brute.SPACE.findall(r[1] or "")) for r in before}
    want, sizes = brute.targets([(r[0], r[3], r[1]) for r in before])
    taken = defaultdict(int)
    for r, n in after.items():
        assert n <= 2 and r in before
        taken[r[3]] += n * size[r[0]]
    for s, target in want.items():
        assert abs(taken[s] - target) <= max((size[r[0]] for r in before if r[3] == s), default=0)


def test_tokens(stages):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        voc = bpe.Vocabulary(bpe.read_ranks(f.read()))
    want = Counter((r[0], r[3], r[1] or "") for r in tuples(stages[3]))
    got = stages[4].collect()
    assert Counter((r["doc_id"], r["source"], voc.decode(bytes(r["ids"])).decode()) for r in got) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)


def test_run_applies_all_stages(spark, sf, stages):
    key = lambda df: Counter((r["doc_id"], bytes(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(stages[-1])


def test_empty_documents(spark, sf, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_files_are_numbered_without_a_copy(spark, sf, monkeypatch):
    from refrain.llm import common
    written = []
    monkeypatch.setattr(common, "stage", lambda df, name, keep=common.stage: (written.append(df.columns), keep(df, name))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert stage(spark, docs, sf).count() > 0
    assert written and not any("text" in columns for columns in written)
    held = common.numbered(docs, "n", "test", files=True)
    numbers = [r["n"] for r in held.select("n").collect()]
    assert len(set(numbers)) == len(numbers) == docs.count() and sorted(numbers) == sorted(r["n"] for r in held.where("n >= 0").select("doc_id", "n").collect())
    plain = common.numbered(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string"), "n", "test", files=True)
    assert plain.select("n").distinct().count() == 2 and written[-1] == ["doc_id", "text", "n"]
