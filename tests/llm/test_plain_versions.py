"""Operators against plain versions of themselves: learned scores, whole tables, long texts, clashing columns, the pipeline."""

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

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"


def test_keep_one_keeps_a_row_of_each_component(spark):

    from sedimenta.llm import simhash

    rng = random.Random(3)
    prose = [" ".join(rng.choice(("rain", "stone", "river", "field")) + str(rng.randrange(99)) for _ in range(60)) for _ in range(12)]
    # null ids with texts of their own, an id that stands on an own text and on a copy, repeats that differ elsewhere
    data = [(2, prose[0], "a"), (5, prose[1], "a"), (5, prose[0], "a"), (7, prose[2], "z"), (7, prose[2], "b"), (7, prose[2], "b"), (None, prose[0], "a"), (9, None, "a"), (None, "", "a")]
    data += [(None, prose[k], "n") for k in range(3, 12)] + [(None, prose[3], "n")]
    near = [[(simhash.fingerprint(a[1]) ^ simhash.fingerprint(b[1])).bit_count() <= 2 for b in data] for a in data]
    comp = list(range(len(data)))
    for _ in data:
        comp = [min(comp[b] for b in range(len(data)) if near[a][b]) for a in range(len(data))]
    assert len(set(comp)) == 13
    runs = []
    for parts in (1, 5):
        df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(parts)
        runs.append(sorted(map(tuple, simhash.keep_one(df).collect()), key=repr))
    got = runs[0]
    assert runs[1] == got and all(r in data for r in got)
    assert sorted(comp[data.index(r)] for r in got) == sorted(set(comp))
    low = {c: min((data[k][0] for k in range(len(data)) if comp[k] == c and data[k][0] is not None), default=None) for c in set(comp)}
    assert all(r[0] == low[comp[data.index(r)]] for r in got)


def tree_scores(texts, held, min_context=8, min_count=2, depth=3, smooth=4.0):
    """The score of each text by the tree of those not held out, from plain dictionaries; and the tree's states by depth."""
    low = [[w.lower() for w in t.split()] + ["\n"] for t in texts]
    train = [w for w, h in zip(low, held) if not h]
    c = collections.Counter(w for t in train for w in t)
    n = sum(c.values())
    total = n + 0.1 * (len(c) + 1)
    level = {(w,): (k, (k + 0.1) / total) for w, k in c.items() if k >= min_count}
    states, entries, sizes = {}, {}, []
    for k in range(1, depth + 1):
        runs = collections.Counter(tuple(t[i : i + k + 1]) for t in train for i in range(len(t) - k))
        known, kept = {}, collections.defaultdict(list)
        for g, m in runs.items():
            if m >= min_count and g[:-1] in level and level[g[:-1]][0] >= min_context and g[1:] in level:
                all_, up = level[g[:-1]][0], level[g[1:]][1]
                own = (m + smooth * up) / (all_ + smooth)
                known[g] = (m, up, own)
                if m * math.log(m / all_ / up) >= math.log(n):
                    kept[g[:-1]].append((own, up))
                    entries[g] = own
        for x, pairs in kept.items():
            states[x] = max((1 - sum(o for o, _ in pairs)) / (1 - sum(u for _, u in pairs)), 1e-9)
        sizes.append(len(kept))
        level = {g: (m, entries.get(g, states.get(g[:-1], 1.0) * up)) for g, (m, up, _) in known.items()}

    def log_p(x, y):
        if not x:
            return math.log10((c[y] + 0.1) / total)
        if x not in states:
            return log_p(x[1:], y)
        return math.log10(entries[*x, y]) if (*x, y) in entries else math.log10(states[x]) + log_p(x[1:], y)

    return [sum(log_p(tuple(t[max(0, k - depth) : k]), t[k]) for k in range(len(t))) for t in low], sizes


@pytest.mark.parametrize("hot", [{}, {"words": 40, "states": 30, "entries": 50, "bits": 9}, {"words": 0, "states": 0, "entries": 0, "bits": 6}])
def test_suffix_tree_against_dictionaries(spark, hot):
    """Whole scores, also where most words, states and entries are not broadcast."""
    from sedimenta.llm import suffixtree

    rng = random.Random(6)
    after = {f"w{k}": [f"w{rng.randrange(300)}" for _ in range(3)] for k in range(300)}
    texts = []
    for _ in range(500):
        t = [f"W{rng.randrange(300)}"]
        while len(t) < 120:
            t.append(rng.choice(after[t[-1].lower()]) if t[-1].lower() in after and rng.random() < 0.9 else f"w{rng.randrange(300)}" if rng.random() < 0.8 else f"r{rng.randrange(9999)}")
        texts.append(" ".join(t))
    texts += ["", "one", "w1 w2"]
    want, sizes = tree_scores(texts, [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))])
    assert sizes[0] > 50 and min(sizes) > 0
    rows = suffixtree.symbols(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    tree = suffixtree.learn(rows.where("not held_out"), min_context=8, min_count=2)
    got = {r["doc_id"]: r["score"] for r in suffixtree.score(rows, tree, suffixtree.Hot(**hot)).collect()}
    assert all(math.isclose(got[i], x, rel_tol=1e-9) for i, x in enumerate(want))


def test_run_numbers_are_alike_in_both_engines(spark):
    from sedimenta.llm import suffixtree

    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**63), 2**63 - 1, 500) for _ in range(2))
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    assert [r[0] for r in df.select(suffixtree.number_of("a", "b")).collect()] == suffixtree.joined(a, b).tolist()


def test_language_learns_seldom_languages(spark):

    from sedimenta.llm import language

    rng = random.Random(2)
    # alphabets of their own: 600 rows of two languages, five rows of each of ten others
    letters = {f"{c}{c}": [chr(0x100 + 40 * k + j) for j in range(12)] for k, c in enumerate("bcdefghijz")} | {"aa": list("etaoin"), "yy": list("шрдлук")}
    prose = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(20))
    data = [(k, prose(lang), lang) for k, lang in enumerate(["aa", "yy"] * 300 + [x for x in sorted(letters) if x not in ("aa", "yy")] * 5)]
    model = language.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), max_train=60)
    assert model["langs"] == sorted(letters)


# --- learned scores from the fitted parameters ---


def test_toxicity_against_a_plain_search(spark):
    from sedimenta.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model["lexicon"]
    model["exceptions"] = {"ring road": [next(iter(model["lexicon"]))]}

    def plain(text):
        t = toxicity.fold(text or "")
        at = collections.defaultdict(dict)
        for term, w in model["lexicon"].items():
            word = term.rstrip("$")
            for s in (m.start() for m in re.finditer(f"(?={re.escape(word)})", t)):
                if not (s and t[s - 1].isalpha()) and not (term.endswith("$") and t[s + len(word) : s + len(word) + 1].isalpha()):
                    at[s][term] = w
        for phrase, terms in model["exceptions"].items():
            for s in (m.start() for m in re.finditer(f"(?={re.escape(phrase)})", t)):
                e = s + len(phrase)
                if not (s and t[s - 1].isalpha()) and not t[e : e + 1].isalpha():
                    for k in range(s, e):
                        for term in terms:
                            at[k].pop(term, None)
        found = [max(h.values()) for h in at.values() if h]
        w, n = sum(found), (t.count(" ") + t.count("\n") + 1 if text else 0)
        z = sum(a * b for a, b in zip(model["curve"], (1, math.log1p(w), math.log1p(100 * w / (n + 10)), math.log1p(n), math.log1p(len(found)))))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    want = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    assert all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in toxicity.score(docs, model).collect())


def test_exceptions_of_beginnings(spark):
    from sedimenta.llm import toxicity

    rows = [("a stupid thing", 1)] * 6 + [("stupid question", 0), ("the stupendous view", 0)] * 6 + [("stupid question stupid", 1)]
    sample = spark.createDataFrame(rows, "text string, label int")
    assert toxicity.learn_exceptions(sample, {"stup": 3.0, "view$": 2.0}) == {"stupendous view": ["stup", "view$"], "the stupendous": ["stup"]}
    auto = toxicity.automaton({"stup": 3.0, "stupid$": 4.0, "idiot$": 2.0}, {"stupid idiot": ["stup", "stupid$"]})
    assert toxicity.measure(auto, "stupid idiot")[:2] == (2.0, 1)  # the phrase excuses its own entries only
    assert toxicity.measure(auto, "stupid")[:2] == (4.0, 1)


def test_quality_ratio_against_plain_counts(spark):
    from sedimenta.llm import quality

    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    texts = [(r["doc_id"], SPACE.findall(r["text"] or "")) for r in docs.collect()]
    words = sorted({w for _, t in texts for w in t})
    h = dict(zip(words, (r[0] for r in spark.createDataFrame(list(enumerate(words)), "i long, w string").orderBy("i").select(F.xxhash64("w")).collect())))
    pairs = sorted({(h[a], h[b]) for _, t in texts for a, b in zip(t, t[1:])})
    h2 = dict(zip(pairs, (r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a long, b long").orderBy("i").select(F.xxhash64("a", "b")).collect())))
    grams = {i: [h[w] % quality.BUCKETS for w in t] + [h2[h[a], h[b]] % quality.BUCKETS for a, b in zip(t, t[1:])] for i, t in texts}
    n, g = collections.Counter(), collections.Counter()
    for i, t in texts:
        n.update(grams[i])
        if i in good:
            g.update(grams[i])
    total, target = (sum(x.values()) + quality.PSEUDO * quality.BUCKETS for x in (n, g))
    ratio = lambda b: math.log((g[b] + quality.PSEUDO) / target) - math.log((n[b] + quality.PSEUDO) / total)
    for r in quality.op4_quality(spark, DIR).collect():
        own = grams[r["doc_id"]]
        llr = sum(map(ratio, own)) / len(own) if own else 0.0
        assert math.isclose(r["llr"], llr, rel_tol=1e-9, abs_tol=1e-12)
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)


def test_language_prediction_against_plain_features(spark):
    from sedimenta.llm import language

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language.fit(docs)
    right, rows = 0, {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    for d in docs.collect():
        clean = "".join(c if c.isalnum() and not c.isdigit() and re.match(r"[^\W\d_]", c) else " " for c in (d["text"] or "").lower())
        clean = f" {' '.join(clean.split())} "
        tf = collections.Counter()
        for k in range(language.ORDERS):
            for i in range(len(clean) - k):
                x = 0
                for j in range(k + 1):
                    x = (x ^ ord(clean[i + j])) * int(language.HASHING[j]) % 2**32
                tf[(x ^ x >> 15) * 0x2C1B3C6D % 2**32 >> 19] += 1
        x = {b: math.log1p(n) * model["idf"][b] for b, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [sum(v / norm * model["weights"][b][k] for b, v in x.items()) + model["weights"][-1][k] for k in range(len(model["langs"]))]
        p = np.exp(np.array(z) - max(z))
        p /= p.sum()
        assert rows[d["doc_id"]]["lang_pred"] == model["langs"][int(p.argmax())] and math.isclose(rows[d["doc_id"]]["score"], p.max(), rel_tol=1e-6)
        right += rows[d["doc_id"]]["held_out"] and rows[d["doc_id"]]["lang_pred"] == d["lang"]
    assert right >= 0.95 * sum(r["held_out"] for r in rows.values())


def test_texts_of_numbers_have_no_language(spark):
    from sedimenta.llm import language

    model = {"langs": ["en"], "weights": np.zeros((language.BUCKETS + 1, 1)), "idf": np.ones(language.BUCKETS)}
    rows = spark.createDataFrame(list(enumerate([None, "", "12", "½ ①", "_", "½ a", "Ⅷ", "日"])), "doc_id long, text string")
    assert [r["lang_pred"] for r in language.predict(rows, model).orderBy("doc_id").collect()] == ["und"] * 5 + ["en", "und", "en"]


# --- files ---


def test_token_files_beat_the_order_0_entropy():
    from sedimenta.llm import tokenfiles

    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    rows = tokenfiles.Encoder(tokenfiles.default_tokenizer()).encode(texts)
    ids = np.frombuffer(b"".join(rows), "<u2")
    data = tokenfiles.write_file(list(range(len(rows))), [len(r) // 2 for r in rows], ids, 5)
    p = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * len(data) / len(ids) < -(p * np.log2(p)).sum() - 1  # a bit better than any order-0 coder, tables and all
    before, docs, lengths, back = tokenfiles.read_file(data)
    assert before == 5 and docs == list(range(len(rows))) and (back == ids).all() and lengths.sum() == len(ids)


@pytest.mark.parametrize("n", [1, 2, 511, 4096, 4097, 9000])
def test_token_files_of_any_length(n):
    from sedimenta.llm import tokenfiles

    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_408, n), np.zeros(n, int), rng.integers(0, 3, n), np.full(n, 49_407)):
        assert (tokenfiles.read_file(tokenfiles.write_file([None], [n], ids.astype(np.uint16)))[3] == ids).all()


def test_token_files_of_one_id_and_many_parts(spark, tmp_path, monkeypatch):
    """A third of all rows has one id or none; files are cut, and places still follow each other."""
    from sedimenta.llm import tokenfiles

    rng = random.Random(1)
    data = [(7 if k % 3 == 0 else None if k % 7 == 0 else k, "same" if k % 5 == 0 else " ".join(rng.choice("abcdef") * 3 for _ in range(k % 50))) for k in range(600)]
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 500)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    parts = tokenfiles.write_token_files(df, str(tmp_path / "t"))
    rows = sorted(tokenfiles.read_token_files(spark, str(tmp_path / "t"), parts).collect(), key=lambda r: r["start"])
    assert len(list((tmp_path / "t").glob("*.cmrc"))) > len(parts)
    at, last = 0, -1
    for r in rows:
        assert r["start"] == at and (r["doc_id"] or -1) >= last
        at, last = at + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]
    enc = tokenfiles.Encoder(tokenfiles.default_tokenizer())
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == collections.Counter((i, enc.encode([t])[0]) for i, t in data)


def test_shards_hold_what_their_manifest_says(spark, tmp_path):
    from sedimenta.llm import sharding

    data = [(1, "same text", "en", "s", "kept", 3)] * 80 + [(k, "t" * k, None, "s", "k", 3) for k in range(40)] + [(None, None, "de", None, "n", 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, row string, shard int")
    found = {r["shard"]: r for r in sharding.write_shards(df, str(tmp_path / "s")).collect()}
    back = spark.read.parquet(str(tmp_path / "s"))
    sizes = {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()}
    assert sizes == {k: r["n_rows"] for k, r in found.items()} and max(sizes.values()) - min(sizes.values()) <= 1
    columns = ["doc_id", "text", "lang", "source", "row"]
    assert collections.Counter(map(tuple, back.select(columns).collect())) == collections.Counter(r[:5] for r in data)
    langs = {r["d0"] for r in sharding.placed(df.where("lang = 'de'")).collect()}
    assert sum(r["min_d0"] <= min(langs) <= r["max_d0"] for r in found.values()) < len(found)  # readers of a language skip shards


# --- whole tables ---

CLASHES = ["spans", "_f", "_tk", "_k", "_i", "_c", "row", "mark", "key", "rid", "s", "h", "m", "fp", "label", "score", "items", "curve", "part", "n"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A text of a million words among short ones, columns of every name that operators use, ids that are null or repeat."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(4)) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = prose(1_000_000)
    texts = [(1, long), (2, prose(80)), (2, prose(80)), (None, prose(90)), (None, prose(90)), (3, " ".join(long.split()[500_000:500_070])), (4, None), (5, ""), (6, "!" * 300_000)] + [(10 + k, prose(40)) for k in range(30)]
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "s", len(t or ""), *[f"x{n}"] * len(CLASHES)) for n, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(long.split()[999_980:])), (None, " ".join(long.split()[10:21]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(10, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, texts


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_decontamination", "op3_pieces", "op4_quality", "op5_hilbert_shards", "op6_substring_dedup", "op7_language", "op8_token_files", "op9_simhash", "op10_suffix_tree"])
def test_long_texts_and_clashing_columns(spark, odd, name):
    from sedimenta.llm import queries

    rows = queries.queries()[name](spark, odd[0]).collect()
    ids = collections.Counter(r["doc_id"] for r in rows)
    assert ids == collections.Counter(i for i, _ in odd[1])
    one = {r["doc_id"]: r for r in rows}
    if name == "op2_decontamination":
        assert (one[1]["n_words"], one[1]["n_hit"], one[1]["n_items"]) == (1_000_000, 31, 1)  # the item without an id is found and not listed
    if name == "op6_substring_dedup":
        assert one[1]["n_words"] == 1_000_000 and one[1]["n_removed"] == 0 and one[3]["n_removed"] == 70
    if name == "op4_quality":
        assert one[1]["n_words"] == 1_000_000
    if name == "op10_suffix_tree":
        assert one[1]["n_tokens"] == 1_000_001


def test_removal_in_one_block_and_in_many(spark, odd):
    from sedimenta.llm import decontamination, substrings

    docs, bench = (spark.read.parquet(f"{odd[0]}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda df: collections.Counter(hashlib.md5(repr(tuple(r)).encode()).hexdigest() for r in df.collect())
    one = decontamination.remove_contamination(docs, bench)
    assert one.columns == docs.columns and rows(one) == rows(decontamination.remove_contamination(docs, bench, block_words=4))
    cut = substrings.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_pipeline_against_plain_stages(spark, tmp_path):
    import sentencepiece
    import xxhash

    import corpus_pipeline
    from sedimenta.llm import decontamination, pieces, toxicity

    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(("rain", "Stone", "river", "élan", "field", "wood")) + str(rng.randrange(60)) for _ in range(n))
    passage, secret = prose(60), prose(30)
    texts = [prose(rng.randrange(5, 120)) for _ in range(50)] + [f"{prose(8)}\n{passage} {prose(7)}" for _ in range(5)] + [f"{prose(9)} {secret} {prose(5)}" for _ in range(3)]
    data = [(k, t, f"s{k % 3}") for k, t in enumerate(texts)]
    # null ids with own texts and with a copy, repeated ids with another text and with a copy, repeated rows, null and empty texts
    data += [(None, prose(70), "n"), (None, prose(70), "n"), (None, texts[0], "n"), (3, prose(66), "o"), (4, texts[1], "o"), (90, None, "z"), (91, "", "z"), data[2], data[2]]
    data += [(100 + k, prose(20) + " badword " + prose(3) + " badword", "t") for k in range(30)]
    d = str(tmp_path)
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, secret)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, *_ in data if i is not None and i not in (3, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    auto = toxicity.automaton(model["lexicon"], model["exceptions"])
    score = lambda t: sum(a * b for a, b in zip(model["curve"], toxicity._features(*toxicity.measure(auto, t))))
    docs = [r for r in docs if score(r[1]) < 0]
    assert docs and not any("badword" in (r[1] or "") for r in docs)

    def fingerprint(t):
        w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(r[1]) for r in docs]
    comp = list(range(len(docs)))
    for _ in docs:
        comp = [min(comp[b] for b in range(len(docs)) if (fps[a] ^ fps[b]).bit_count() <= 2) for a in range(len(docs))]
    best = {}
    for k, r in enumerate(docs):  # of rows of one id the order is that of fingerprints and hashes, which tells equal texts only
        best.setdefault(comp[k], []).append((r[0] is None, r[0] or 0, k))
    docs = [docs[min(v)[2]] for v in best.values()]

    first = {}
    for i, t, _ in docs:
        w = SPACE.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    cut = []
    for i, t, s in docs:
        at, gone = list(SPACE.finditer(t or "")), set()
        for k in range(len(at) - 49):
            if i is not None and first[tuple(m[0] for m in at[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        ends = [m.start() for m in at[1:]] + [len(t or "")]
        cut.append((i, t if not gone else "".join([t[: at[0].start()], *(t[m.start() : e] for k, (m, e) in enumerate(zip(at, ends)) if k not in gone)]), s))
    bench = decontamination.words_of(secret)
    windows = {tuple(bench[k : k + 10]) for k in range(len(bench) - 9)}
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = collections.Counter()
    for i, t, s in cut:
        low = (t or "").encode().translate(decontamination.LOWER)
        at, hit = list(decontamination.WORDS.finditer(low)), set()
        for k in range(len(at) - 9):
            if tuple(m[0] for m in at[k : k + 10]) in windows:
                hit |= set(range(k, k + 10))
        raw, out, done, k = (t or "").encode(), [], 0, 0
        while k < len(at):
            if k in hit:
                e = k
                while e + 1 in hit:
                    e += 1
                out.append(raw[done : at[k].start()])
                done, k = at[e].end(), e
            k += 1
        text = None if t is None else b"".join([*out, raw[done:]]).decode()
        want[(i, text, s, tuple(lib.encode(text or "", add_bos=True, add_eos=True)))] += 1
    got = collections.Counter((r["doc_id"], r["text"], r["source"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, d).collect())
    assert got == want
    assert sum(k[0] is None for k in got) == 2 and sum(k[0] == 3 for k in got) == 2
