"""The ten operators against brute force on small tables with nulls, empty and repeated rows, and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sedimenta.llm.queries")
from sedimenta.llm import decontamination, queries, sharding, simhash, substrings, tokenfiles, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, spans int, fp string, held_out int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(("the", "Of", "and", "rain", "stone", "élan", "über", "x1")) + rng.choice(("", "", "ly", "s")) for _ in range(n))
    passage = prose(70)
    out = [prose(rng.randrange(1, 160)) for _ in range(40)]
    out += [f"{prose(20)} {passage} {prose(9)}" for _ in range(6)] + [f"{passage}\n{passage}"]
    out += [out[3], out[3], f"{out[3]} tail", None, "", "   ", "one", "日本語 ▁ <s> <|endoftext|> Σας", "1d10t " + prose(30), "line\nline\n\n a\tb\vc" + prose(12)]
    return out


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("data"))
    rows = [(i if i != 20 else None, t, None if i % 9 == 0 else ("en", "de")[i % 2], f"src{i % 3}", len(t or ""), "s", "h", 1, "f", 2) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    bench = [(1, " ".join(WORDS.findall(texts[41])[25:45])), (2, "one"), (3, None), (4, ""), (10, " ".join(WORDS.findall(texts[0])[:12]))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, nothing, name):
    assert queries.queries()[name](spark, nothing).collect() == []


@pytest.fixture(scope="module")
def run(spark, folder):
    held = {}

    def get(name):
        if name not in held:
            held[name] = queries.queries()[name](spark, folder).collect()
        return held[name]

    return get


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"pipeline", "op11_embedding_dedup", "op12_ranked_search", "op13_filter_audit"}))
def test_every_row_once(run, docs, name):
    key = lambda i: (i is None, i or 0)
    assert sorted((r["doc_id"] for r in run(name)), key=key) == sorted((i for i, _ in docs), key=key)


def test_decontamination(run, spark, folder, docs):
    items = [(r["item_id"], decontamination.words_of(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in run("op2_decontamination"))
    want = collections.Counter()
    for i, t in docs:
        w, hit, ids = decontamination.words_of(t), set(), set()
        for item, b in items:
            for a in range(max(1, len(b) - 9) if b else 0):
                win = b[a : a + 10]
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        ids.add(str(item))
        want[(i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    assert got == want


def test_decontamination_in_blocks(spark, folder):
    d, b = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = lambda df: collections.Counter(str(tuple(r)) for r in df.collect())
    assert rows(decontamination.find_contamination(d, b, block_words=10)) == rows(decontamination.find_contamination(d, b))


def test_pieces(run, docs):
    import sentencepiece
    from sedimenta.llm.pieces import default_model

    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = collections.Counter()
    for i, t in docs:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run("op3_pieces")) == want


def test_quality_base(run, docs):
    want = collections.Counter()
    for i, t in docs:
        t = t or ""
        w, places = WORDS.findall(t), collections.defaultdict(list)
        for k in range(len(w) - 4):
            places[tuple(w[k : k + 5])].append(k)
        again = {k + z for v in places.values() if len(v) > 1 for k in v for z in range(5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))] += 1
    assert collections.Counter(tuple(r)[:7] for r in run("op4_quality")) == want
    assert not any(r["kept"] and r["base_failed"] for r in run("op4_quality"))


def test_sharding(run, docs, spark, folder):
    rows = run("op5_hilbert_shards")
    sizes = collections.Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(40)) <= 1 and set(sizes) <= set(range(40))
    for k in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    at = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    path = at[np.argsort(sharding.hilbert_index(at, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_substrings(run, docs):
    first = {}
    for i, t in docs:
        w = WORDS.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = collections.Counter()
    for i, t in docs:
        w, gone = WORDS.findall(t or ""), set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        want[(i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, run("op6_substring_dedup"))) == want


def test_factors_join_where_positions_advance():
    hits = [{"s": s, "n": 1, "d": 1, "r": s + 5} for s in (0, 1, 2)] + [{"s": 3, "n": 1, "d": 2, "r": 0}]
    assert substrings.parse(hits) == [(0, 52, 1, 5), (3, 53, 2, 0)]


def test_language(run, docs):
    for r in run("op7_language"):
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und")
    text = dict(docs)
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text[r["doc_id"]] or "")) for r in run("op7_language"))


def test_token_files(run, docs):
    from tokenizers import Tokenizer

    lib, at = Tokenizer.from_file(tokenfiles.default_tokenizer()), 0
    ids = {}
    for i, t in docs:
        ids[i] = lib.encode(t or "", add_special_tokens=False).ids + [1]
    for r in sorted(run("op8_token_files"), key=lambda r: r["start"]):
        want = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_a_damaged_block_is_noticed():
    data = bytearray(tokenfiles.write_file([1], [3000], np.arange(3000, dtype=np.uint16) % 700))
    assert (tokenfiles.read_file(bytes(data))[3] == np.arange(3000) % 700).all()
    data[-900] ^= 4
    with pytest.raises((ValueError, IndexError)):
        tokenfiles.read_file(bytes(data))


def test_simhash(run, docs):
    import xxhash

    fps = []
    for _, t in docs:
        w = WORDS.findall(lower(t or ""))
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(fps)))
    for _ in range(len(fps)):
        comp = [min(comp[b] for b in range(len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 2) for a in range(len(fps))]
    low = {c: min((docs[k][0] for k in range(len(docs)) if comp[k] == c and docs[k][0] is not None), default=None) for c in set(comp)}
    want = collections.Counter((docs[k][0], f"{fps[k]:016x}", low[comp[k]]) for k in range(len(docs)))
    assert collections.Counter(map(tuple, run("op9_simhash"))) == want


def test_split_groups_lose_no_link(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(60)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    label = lambda part: {r["node"]: r["label"] for r in simhash.components(simhash.links(df, part)).collect()}
    assert label(7) == label(1000)


def test_suffix_tree_base(run, docs):
    tok = lambda t: [*WORDS.findall(lower(t or "")), "\n"]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    c = collections.Counter()
    for i, t in docs:
        if not held(i):
            c.update(tok(t))
    total = sum(c.values()) + 0.1 * (len(c) + 1)
    text = dict(docs)
    for r in run("op10_suffix_tree"):
        w = tok(text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), sum(c.values()), held(r["doc_id"]))
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.1) / total) for x in w), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_toxicity_folds_and_excuses():
    assert toxicity.fold("1D10T 100 іdiоt $tup1d") == "idiot 100 idiot stupid"
    auto = toxicity.automaton({"idiot$": 3.0, "stup": 2.0}, {"stupid question": ["stup"]})
    assert toxicity.measure(auto, "an 1d10t, STUPIDLY so")[:2] == (5.0, 2)
    assert toxicity.measure(auto, "a stupid question, idiotic")[:2] == (0, 0)


def test_pipeline(spark, folder):
    out = queries.queries()["pipeline"](spark, folder)
    rows = out.collect()
    assert {"doc_id", "text", "lang", "ids", "n_tokens", "spans"} <= set(out.columns) and rows
    bench = decontamination.words_of("one")
    assert not any(bench[0] in decontamination.words_of(r["text"]) for r in rows)
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
