"""What once grew with the square of something, or stopped at some size."""

import collections
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sedimenta.llm.queries")
from sedimenta.llm import common, language, simhash, substrings, suffixtree, tokenfiles, toxicity  # noqa: E402


@pytest.mark.parametrize("total", [10, 10**6, 4 * 10**9, 10**13, 10**17])
def test_a_share_of_hashes_is_never_empty(spark, total):
    """The rows taken are about 3,000 whatever the table's size; a share in millionths took none beyond 3 billion."""
    part = min(1.0, 3000 / total)
    least = spark.range(1).select(language.within(F.lit(-(2**63)).cast("long"), part)).first()[0]
    assert least  # the smallest hash is always in it
    bound = min(2**63 - 1, int(part * 2**64) - 2**63)
    assert (bound + 2**63) / 2**64 == pytest.approx(part, rel=1e-6)


def test_language_with_thousands_of_rare_values(spark):
    """Seldom languages are found by a join, not by a list in the plan; and every one of them is learned."""
    rng = np.random.default_rng(1)
    rows = [(i, "the and of " * int(rng.integers(1, 9)), "en") for i in range(400)]
    rows += [(1000 + i, f"{'xyzw'[i % 4] * 3}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)} " * 5, f"l{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, max_train=100)
    trained = {lang for i, _, lang in rows if not common.held_out_py(i, language.FOLDS)}
    assert set(model["langs"]) == trained


def test_exceptions_are_walked_once():
    lexicon, exceptions = {"bad$": 3.0, "evil": 2.0}, {"not bad": ["bad$"], "evil twin": ["evil"]}
    auto = toxicity.automaton(lexicon, exceptions)
    assert toxicity.measure(auto, "not bad but bad and an evil twin, evil") == (5.0, 2, 9)
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        weight, hits, _ = toxicity.measure(auto, "not bad " * n + "bad")
        took.append(time.perf_counter() - began)
        assert (weight, hits) == (3.0, 1)
    assert took[1] < 30 * took[0]  # eight times the text: the square would be 64 times


def test_a_labelled_id_on_many_rows_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"kind words {i}") for i in range(500)] + [(2, "foul stuff"), (3, "kind"), (6, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (6, 1)], "doc_id long, toxic int")
    taught = []
    real, toxicity.learn_lexicon = toxicity.learn_lexicon, lambda sample: taught.append(sample.count()) or {}
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.learn_lexicon = real
    ids = {i for i in (1, 2, 3, 6) if not common.held_out_py(i, toxicity.FOLDS)}
    assert taught == [len(ids)]


def test_repeated_rows_find_the_factors_of_one(spark):
    passage = " ".join(f"w{i}" for i in range(90))
    rows = [(1, f"{passage} one end"), (2, f"start {passage} two"), (3, f"{passage} {passage}")]
    schema = "doc_id long, text string"
    once = {(r["doc_id"], r["tk"]): sorted(map(tuple, r["f"])) for r in substrings.factors(spark.createDataFrame(rows, schema)).collect()}
    many = {(r["doc_id"], r["tk"]): sorted(map(tuple, r["f"])) for r in substrings.factors(spark.createDataFrame(rows + [rows[1]] * 39, schema)).collect()}
    assert once and once == many


def test_a_context_that_stands_twice_is_judged(spark):
    """A passage that stands in two documents is in the tree, however many others there are."""
    rng = np.random.default_rng(4)
    rare = [f"rare{i}" for i in range(30)]
    texts = [" ".join(f"c{k}" for k in rng.integers(0, 50, 60)) for _ in range(300)]
    texts[10] += " " + " ".join(rare)
    texts[200] += " " + " ".join(rare)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = suffixtree.learn(suffixtree.symbols(docs), min_context=2, min_count=2)
    h = np.frombuffer(suffixtree.symbols_of([" ".join(rare)])[0], "<i8")[:-1]
    pairs = suffixtree.runs(h, 1)[1][1:]
    known = {r["key"] for r in tree.entries.select("key").collect()}
    assert set(pairs.tolist()) <= known


def test_the_suffix_tree_keeps_no_copy_of_the_texts(spark, tmp_path, monkeypatch):
    """Symbols took more disk than the texts, through all passes; and blocks of counts stayed until their joins were done."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 9, 200))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tags, real = [], suffixtree.saved
    monkeypatch.setattr(suffixtree, "saved", lambda df, tag: tags.append(tag) or real(df, tag))
    got = {r["doc_id"]: r["score"] for r in suffixtree.op10_suffix_tree(spark, str(tmp_path)).collect()}
    assert "symbols" not in tags
    assert tags.index("counted") < tags.index("runs")
    kept = suffixtree.symbols(docs)
    want = {r["doc_id"]: r["score"] for r in suffixtree.score(kept, suffixtree.learn(kept.where("not held_out"))).collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_scratch_is_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return collections.defaultdict(lambda: None)

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        common.scratch_root(Session())


def test_paths_of_spark_are_known_to_arrow():
    from pyarrow import fs

    assert tokenfiles.arrow_uri("s3a://bucket/warehouse/t") == "s3://bucket/warehouse/t" and tokenfiles.arrow_uri("file:///a/b") == "file:///a/b"
    store, base = fs.FileSystem.from_uri(tokenfiles.arrow_uri("s3a://bucket/t?region=us-east-1&endpoint_override=localhost:9"))  # refused as s3a before
    assert store.type_name == "s3" and base == "bucket/t"


def test_fingerprints_meet_without_the_driver(spark):
    """Links, labels and components are joined by shuffles: no side is gathered, however small its files look."""
    docs = spark.createDataFrame([(i, f"one two three four {i % 7} five six seven") for i in range(40)], "doc_id long, text string")
    own = common.saved(simhash.fingerprints(docs), "fingerprints")
    for made in (simhash.links(own.select("fp").distinct()), simhash.near_duplicates(docs)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
