import hashlib
import json
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import compare, oracle
from netresil.llm import decontaminate, jaccard, language, licenses, maxent, mixing, quality, substrings, syncmers, text, token_counts
from netresil.llm.queries import ORACLE, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, n_hit int, size int, score string, kept string, doc string, body string, rep int, key string"


def rows(*docs):
    """Documents with further columns whose names clash with those the operators use inside or return."""
    return [(i, t, lang, source, len(t) if t else 0, 7, 7, 7, "x", "x", "x", "x", 7, "x") for i, t, lang, source in docs]


LONG = " ".join(f"w{i % 977} the" for i in range(30_000))
ODD = rows(
    (1, "The cat sat on the mat, and then the cat went home again.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n\x0b ", "fr", "b"),
    (5, "Le chat était sur le tapis et puis le chat est rentré.", "fr", "b"), (6, LONG, "en", "a"), (7, LONG, "en", None), (8, "12 34 !!", None, "a"),
    (9, "same text twice over", "en", "c"), (9, "same text twice over", "en", "c"), (None, "no id at all but some words", "en", "c"),
    (10, "x" * 5000, "en", "c"), (11, "same text twice over", None, "c"), (12, "naïve café 東京 text", "fr", "b"),
)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "sat on the mat"), (2, None), (3, ""), (None, "sur le tapis"), (4, "?!")], "item_id bigint, text string")


def babble(seed, n, vocabulary=40, longest=60, copies=0.4):
    """Random texts with exact copies, near copies and shared passages."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < copies:
            w = list(r.choice(out)[1].split(" "))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = f"v{r.randrange(vocabulary)}"
            if r.random() < 0.3:
                w = w + [f"v{r.randrange(vocabulary)}" for _ in range(3)]
        else:
            w = [f"v{r.randrange(vocabulary)}" for _ in range(r.randrange(1, longest))]
        out.append((i, " ".join(w)))
    return out


def test_words_and_hashes():
    column = pa.array(["ab  cd\te", None, "", " x ", "abcdefghijklmnop q", "AB cd"])
    w = text.words(column, fold=True)
    got = [[bytes(w.data[a:b]) for a, b in zip(w.starts[s:e], w.ends[s:e])] for s, e in zip(w.bounds[:-1], w.bounds[1:])]
    assert got == [[b"ab", b"cd", b"e"], [], [], [b"x"], [b"abcdefghijklmnop", b"q"], [b"ab", b"cd"]]
    h = text.word_hashes(w)
    assert h[0] == h[6] and h[1] == h[7] and len(set(h.tolist())) == 6
    assert [len(b) for b in text.chunks([pa.RecordBatch.from_pydict({"t": ["a" * 10] * 5})], "t", 25)] == [2, 2, 1]


@pytest.mark.parametrize("length", [1, 2, 3, 5, 10, 20])
def test_window_hashes_depend_on_their_words_alone(length):
    r = np.random.default_rng(1)
    h = text.mix(r.integers(0, 3, 4000).astype(np.uint64))
    got = text.windows(h, length)
    want = [tuple(h[i : i + length]) for i in range(len(h) - length + 1)]
    assert len(got) == len(want) and len(set(got.tolist())) == len(set(want)) == len(set(zip(got.tolist(), want)))
    assert text.sliding_min(h, length).tolist() == [min(w) for w in want]


def test_odd_rows_language(spark, odd, empty):
    trees = language.learn(odd)
    got = {(r["doc_id"], r["text"]): r for r in language.identify(odd, trees).collect()}
    for key in ((2, None), (3, ""), (4, " \t\n\x0b "), (8, "12 34 !!")):
        assert (got[key]["lang_pred"], got[key]["score"]) == ("und", 0.0)
    assert got[(5, ODD[4][1])]["lang_pred"] == "fr" and got[(1, ODD[0][1])]["lang_pred"] == "en"
    assert language.identify(empty, trees).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.learn(empty)).collect()} == {"und"}
    assert {r["doc_id"] for r in language.accepted(odd, trees).collect()} == {1, 5, 6, 7, 9, None, 10, 11, 12}


def test_language_code_lengths_are_exact():
    train = {"en": ["the cat sat", "then that"], "fr": ["le chat était là", "et puis le"]}
    order = 3
    counts = {}
    for lang, texts in train.items():
        grams, first, last = language._packed(pa.array(texts), order)
        counts[lang] = {}
        for a, b in zip(first, last):
            for g in grams[a:b].tolist():
                counts[lang][g] = counts[lang].get(g, 0) + 1
    trees = language.build(counts, order)
    probes = ["the chat", "", "zzz", "puis then là", "Ünïcode"]
    bits, length = language.code_lengths(trees, pa.array(probes))
    for j, lang in enumerate(trees.languages):
        tree = brute.ContextTree(train[lang], order)
        assert np.allclose(bits[:, j], [tree.bits(p) for p in probes], rtol=1e-5, atol=1e-4)
    assert length.tolist() == [len(p.encode()) for p in probes]


def test_language_held_out_accuracy(spark):
    got = QUERIES["op1_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_maxent(spark, odd, empty):
    docs = babble(3, 120)
    train, score = [d for d in docs if d[0] % 4], brute.unigram([d for d in docs if d[0] % 4])
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    trained = maxent.train(frame.where("doc_id % 4 > 0"))
    got = maxent.score(frame, trained).collect()
    for r in got:
        n, known, total, base = score(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and abs(r["base_score"] - base) < 1e-9 * abs(base) + 1e-9
        assert r["score"] < 0
    assert len(got) == len(docs) and train
    strange = {(r["doc_id"], r["text"]): r for r in maxent.score(odd, trained).collect()}
    assert strange[(2, None)]["n_tokens"] == strange[(4, " \t\n\x0b ")]["n_tokens"] == 1
    assert strange[(6, LONG)]["n_tokens"] == 60_001
    assert maxent.score(empty, trained).count() == 0
    nothing = maxent.score(odd, maxent.train(empty)).collect()
    assert len(nothing) == len(ODD) and {(r["n_known"], r["train_tokens"], r["score"]) for r in nothing} == {(0, 0, 0.0)}


def test_maxent_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(babble(5, 60, vocabulary=12), "doc_id bigint, text string")
    words = [f"v{i}" for i in range(12)]
    trained = maxent.train(docs)
    # All words that can follow, one never seen, and the end: the chance of a text "v1 w ..." over all next tokens.
    probe = [(0, "v1"), *[(i + 1, f"v1 {w}") for i, w in enumerate(words)]]
    got = {r["text"]: r["score"] for r in maxent.score(spark.createDataFrame(probe, "doc_id bigint, text string"), trained).collect()}
    model = trained[0]
    t = maxent.tokens(pa.array([p for _, p in probe]))
    cls, prev, word = model.rows(t)
    z = np.exp(model.logits(model.features(t)).astype(np.float64))
    assert np.allclose((z / z.sum(axis=1, keepdims=True)).sum(axis=1), 1)
    table = 10.0 ** model.word_log
    of = np.concatenate((model.word_class, np.arange(maxent.CLASSES)))
    for before in range(maxent.CLASSES):
        assert np.allclose(np.bincount(of, table[:, before], maxent.CLASSES)[np.unique(of)], 1, atol=1e-4)
    assert all(v < 0 for v in got.values())


def test_maxent_beats_the_base_on_held_out_texts(spark):
    got = QUERIES["op2_maxent"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


@pytest.mark.parametrize("size", [1 << 24, 60])
def test_decontamination(spark, odd, empty, items, size):
    bench = [(r["item_id"], r["text"]) for r in items.collect()]
    for window in (10, 2):
        got = decontaminate.contamination(odd, items, window=window, automaton_bytes=size).collect()
        assert len(got) == len(ODD)
        for r in got:
            if r["text"] != LONG:
                assert (r["n_words"], r["n_hit"], r["items"]) == brute.contamination(r["text"], bench, window)
                assert sum(len(brute.alnum(r["text"][s["start"] : s["stop"]])) for s in r["spans"]) == r["n_hit"]
    spans = next(r for r in got if r["doc_id"] == 5)["spans"]
    assert [ODD[4][1][s["start"] : s["stop"]] for s in spans] == ["sur le tapis"]
    assert decontaminate.contamination(empty, items).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(odd, items.limit(0)).collect()} == {0}


@pytest.mark.parametrize("window", [1, 2, 5, 20])
def test_substrings(spark, odd, empty, window):
    docs = babble(window, 150, vocabulary=6 if window > 2 else 400)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    want = brute.remove_repeats(docs, window)
    for r in substrings.remove_repeats(frame, window=window).collect():
        w, gone = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    strange = {(r["doc_id"], r["text"]): r for r in substrings.remove_repeats(odd, window=window).collect()}
    assert len(substrings.remove_repeats(odd, window=window).collect()) == len(ODD)
    assert strange[(7, LONG)]["n_removed"] == 60_000 and strange[(2, None)]["n_words"] == 0
    assert strange[(None, "no id at all but some words")]["n_removed"] == 0
    if window <= 2:
        assert strange[(9, "same text twice over")]["n_removed"] == 0 and strange[(11, "same text twice over")]["n_removed"] == 4
    assert substrings.remove_repeats(empty, window=window).count() == 0


def test_syncmers(spark, odd, empty):
    docs = babble(11, 60, vocabulary=500, longest=200)
    docs = [(i * i, t) for i, t in docs]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in syncmers.fingerprints(frame).collect()}
    follow = dict(zip([t for _, t in docs], [t for _, t in docs[1:] + docs[:1]]))
    for n, (i, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[(n + 1) % len(docs)][1][:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    prints = {}
    for i, t in docs:
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert follow
    strange = syncmers.fingerprints(odd).collect()
    assert len(strange) == len(ODD)
    by = {r["doc_id"]: r for r in strange}
    assert by[6]["near_next"] == 1.0 and by[2]["fingerprint"] == by[3]["fingerprint"] == by[4]["fingerprint"] == "" and by[2]["near_next"] == 1.0
    assert by[2]["n_chars"] == 0 and by[12]["n_chars"] == len(ODD[-1][1])
    assert syncmers.fingerprints(empty).count() == 0
    alone = syncmers.fingerprints(spark.createDataFrame([(1, "one text only here now and then")], "doc_id bigint, text string")).first()
    assert alone["near_next"] == alone["near_edited"] * 0 + 1.0


def test_syncmers_are_chosen_by_their_own_words(spark):
    """Closed syncmers, computed plainly from Spark's own hashes."""
    words = [f"v{i * i % 37}" for i in range(200)]
    h = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(F.xxhash64("w")).collect()]
    k, s = syncmers.K, syncmers.S
    inner = spark.createDataFrame([(i, h[i : i + s]) for i in range(len(h) - s + 1)], "i int, h array<bigint>").select("i", F.xxhash64(*[F.get("h", F.lit(j)) for j in range(s)]).alias("m"))
    m = [r["m"] for r in inner.orderBy("i").collect()]
    chosen = [i for i in range(len(h) - k + 1) if min(m[i : i + k - s + 1]) in (m[i], m[i + k - s])]
    runs = spark.createDataFrame([(h[i : i + k],) for i in chosen], "h array<bigint>").select(F.xxhash64(*[F.get("h", F.lit(j)) for j in range(k)]).bitwiseAND(F.lit(0xFFFFFFFF)).alias("v"))
    want = sorted({r["v"] for r in runs.collect()})[: syncmers.ANCHORS]
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(syncmers.sketch(F.col("t")).alias("a")).first()["a"]
    assert got == want


def test_token_counts(spark, odd, empty):
    from tokenizers import Tokenizer

    special = [(100, "a <|endoftext|> b<|endoftext|>", "en", "a"), (101, "don't  stop\n\n now…  ", "en", "a"), (102, "  x　y  z 12345 ½", None, None)]
    frame = odd.unionByName(spark.createDataFrame(rows(*special), COLUMNS))
    plain = Tokenizer.from_file(TOKENIZER)
    got = token_counts.token_counts(frame, TOKENIZER).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        assert r["n_tokens"] == len(plain.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((r["text"] or "").encode())
    assert token_counts.token_counts(empty, TOKENIZER).count() == 0


def test_whole_tokens_are_proven():
    from tokenizers import Tokenizer

    with open(TOKENIZER, encoding="utf-8") as f:
        source = f.read()
    whole = token_counts.whole_tokens(source)
    plain = Tokenizer.from_str(source)
    assert len(whole) > 30_000 and "<|endoftext|>" not in whole
    assert all(len(plain.encode(s).ids) == 1 for s in list(whole)[::50])
    assert len(json.loads(source)["model"]["vocab"]) >= len(whole)


@pytest.mark.parametrize("seed, longest, length, percent", [(1, 14, 4, 85), (2, 60, 4, 85), (3, 25, 2, 85), (4, 40, 5, 80), (5, 9, 1, 60)])
def test_jaccard_components(spark, seed, longest, length, percent):
    docs = babble(seed, 160, vocabulary=60, longest=longest, copies=0.7)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame, length=length, percent=percent).collect()}
    assert got == brute.components(docs, length, percent)


def test_jaccard_several_texts_of_one_size_under_one_id(spark):
    # ids 1 and 9 hold several texts of as many shingles; every one of them links, whichever row comes first
    run = lambda w, n: " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, run(w, 30)) for w in "abcd"] + [(k + 2, run(w, 31)) for k, w in enumerate("abcd")]
    rows += [(9, run("e", 30)), (9, run("f", 40)), (10, run("e", 31)), (11, run("f", 41)), (12, run("g", 30))]
    for order in (rows, rows[::-1]):
        got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (9, 9), (10, 9), (11, 9), (12, 12)}


def test_jaccard_odd_rows(odd, empty):
    got = [tuple(r) for r in jaccard.jaccard_components(odd).collect()]
    assert len(got) == len(ODD)
    by = {r[0]: r[1:] for r in got}
    assert by[7] == (by[6][0], 6) and by[2] == (0, 2) and by[3] == (0, 3) and by[9] == (1, 9) and by[11] == (1, 9) and by[None][1] is None
    assert jaccard.jaccard_components(empty).count() == 0


def test_light_and_heavy_sets_cover_every_link():
    """Two linked sets always share a key: a subset size, or a place in the lists."""
    for percent in (60, 80, 85):
        for boundary in (0, 6, 12):
            for n in range(1, 40):
                for m in jaccard.partners(n, percent):
                    if n <= boundary and m <= boundary:
                        c = jaccard.least_overlap(n, m, percent)
                        assert c in jaccard.subset_sizes(n, boundary, percent) and c in jaccard.subset_sizes(m, boundary, percent)
                    elif m > 0:
                        assert min(n, m) >= jaccard.partners(boundary + 1, percent)[0]
    assert jaccard.choose_boundary({5: 1000, 9: 100, 300: 5000}) >= 5


def test_quality(spark, odd, empty):
    r = random.Random(4)
    docs, marks = [], []
    for i in range(300):
        w = [r.choice(["alpha", "beta", "gamma", "delta", "road", "river"]) for _ in range(30)]
        bad = i % 4 == 0
        docs.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)))
        marks.append((i, int(not bad)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (7, None)], "doc_id bigint, quality int")
    voters = quality.learn(frame, labels.where("doc_id % 5 > 0"))
    got = {x["doc_id"]: x["score"] for x in quality.score(frame, voters).collect()}
    held = [i for i in range(0, 300, 5)]
    assert np.mean([(got[i] >= 0.7) == bool(marks[i][1]) for i in held]) > 0.95
    strange = quality.score(odd, voters).collect()
    assert len(strange) == len(ODD) and all(0 <= x["score"] <= 1 for x in strange)
    assert quality.score(empty, voters).count() == 0 and quality.learn(frame, labels.limit(0)) is None
    assert {x["score"] for x in quality.score(odd, None).collect()} == {0.5}


def test_mixing(spark, odd, empty):
    docs = [(i, " ".join(["w"] * (i % 50 + 1)), ["a", "b", "c", None][i % 4 if i < 60 else 0]) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = mixing.mix(frame).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(frame.repartition(9)).collect()}
    total = sum(len(t.split()) for _, t, _ in docs)
    targets = {r["source"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    for source, target in targets.items():
        own = [r for r in got if r["source"] == source]
        size = sum(r["size"] for r in own)
        assert sum(r["taken"] for r in own) == int(target) and target <= 2 * size and {r["source_size"] for r in own} == {size}
    assert all(0 <= r["taken"] <= 2 * r["size"] and again[r["doc_id"]] == r["taken"] for r in got)
    strange = mixing.mix(odd).collect()
    assert len(strange) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in strange)
    assert mixing.mix(empty).count() == 0
    assert {r["taken"] for r in mixing.mix(odd.where("doc_id in (2, 3)")).collect()} == {0}


def test_native_operators_use_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame in (syncmers.fingerprints(docs), mixing.mix(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, sizes = docs, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(kept.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stage = {k: [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / str(k))).collect()] for k in range(5)}
    assert sorted(i for i, _ in stage[1]) == sorted(i for i, (n, c) in brute.components(stage[0], 5, 80).items() if i == c)
    want = {i: " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else dict(stage[1])[i] for i, (w, gone) in brute.remove_repeats(stage[1], 20).items()}
    assert dict(stage[2]) == {i: t for i, t in want.items() if t or not dict(stage[1])[i]}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in stage[3]) == sorted(i for i, t in stage[2] if not brute.contamination(t, bench, 10)[1])
    assert set(stage[4]) <= set(stage[3]) <= set(stage[2]) and len(before) == sizes[0] >= sizes[1] >= sizes[4] > 0
    assert corpus_pipeline.run(spark, SF).count() == sizes[5]


def test_pipeline_keeps_one_of_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten"
    frame = spark.createDataFrame([(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, text, "en", "a", 9), (None, text, "en", "a", 9), (3, "", "en", "a", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicate_stage(spark, frame, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 3]


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name, columns", [
    ("op1_language", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    ("op2_maxent", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}),
    ("op5_syncmers", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}),
    ("op6_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}),
    ("op9_quality", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
])
def test_query_columns(spark, name, columns):
    got = QUERIES[name](spark, SF)
    assert {k: v for k, v in got.dtypes if k in columns} == columns
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_license_scan(spark, odd, empty):
    r = random.Random(9)
    filler = lambda n: " ".join(r.choice(["road", "river", "under", "the", "license", "version"]) for _ in range(n))
    docs, want = [], {}
    names = sorted(licenses.NOTICES)
    for i in range(80):
        chosen = r.sample(names, i % 3)
        docs.append((i, "\n".join([filler(r.randrange(60)), *[f"{licenses.NOTICES[n]} {filler(r.randrange(30))}" for n in chosen]])))
    for i, t in docs:
        got = set()
        for n in names:
            w, v = brute.alnum(t), brute.alnum(licenses.NOTICES[n])
            grams = set(brute.runs(v, 3)) if len(v) >= 3 else {tuple(v)}
            size = licenses._level(len(v))
            if any(len(grams & set(brute.runs(w[p : p + len(v)], 3))) >= 0.8 * len(grams) for p in range(len(w))):
                got.add(n)
            assert size >= len(v)
        want[i] = got
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for words in (10**6, 60):
        for row in licenses.license_scan(frame, licenses.notices(spark), template_words=words).collect():
            assert {m["license"] for m in row["licenses"]} >= want[row["doc_id"]]
            for m in row["licenses"]:
                inside = brute.alnum(row["text"][m["start"] : m["stop"]])
                v = brute.alnum(licenses.NOTICES[m["license"]])
                assert m["containment"] >= 0.8 and set(brute.runs(v, 3)) & set(brute.runs(inside, 3))
    strange = licenses.license_scan(odd, spark.createDataFrame([("a", "twice over"), ("b", None), (None, "text"), ("c", "!"), ("d", "東京")], "license string, text string")).collect()
    assert len(strange) == len(ODD)
    found = {(x["doc_id"], m["license"], x["text"][m["start"] : m["stop"]]) for x in strange for m in x["licenses"]}
    assert found == {(9, "a", "twice over"), (11, "a", "twice over"), (12, "d", "東京")}
    assert licenses.license_scan(empty, licenses.notices(spark)).count() == 0
    assert {len(x["licenses"]) for x in licenses.license_scan(odd, licenses.notices(spark).limit(0)).collect()} == {0}


def test_license_query_finds_every_planted_notice(spark):
    got = {r["doc_id"]: set(r["licenses"].split(",")) - {""} for r in QUERIES["op7_licenses"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    for d in docs:
        lines = (d["text"] or "").split("\n")
        assert got[d["doc_id"]] == {n for n, t in licenses.NOTICES.items() if any(line.strip() == t for line in lines)} | (got[d["doc_id"]] if any(t[:-1] in (d["text"] or "") for t in licenses.NOTICES.values()) else set())
    assert any(got.values())


def test_license_siblings_are_told_apart(spark):
    at = Path(licenses.__file__).parent / "license_texts"
    full = {n: (at / f"{n}.txt").read_text(encoding="utf-8") for n in licenses.FULL}
    lead = "This work is licensed under the GNU"
    affero = full["gpl-3.0"].replace("GNU GENERAL PUBLIC LICENSE\n", "GNU AFFERO GENERAL PUBLIC LICENSE\n", 1).replace("29 June 2007", "19 November 2007").replace("GNU General", "GNU Affero General")
    cases = {
        f"{lead} General Public License, version 2.": "gpl-2.0", f"{lead} Lesser General Public License, version 3.": "lgpl-3.0",
        f"{lead} Affero General Public License, version 3.": "agpl-3.0", f"{lead} General Public License, version 3.": "gpl-3.0",
        **{t: n for n, t in licenses.FURTHER}, licenses.NOTICES["cc-by-sa-4.0"]: "cc-by-sa-4.0", licenses.NOTICES["bsd"]: "bsd",
        **{t: n for n, t in full.items()}, affero: "agpl-3.0-or-later", full["bsd-3-clause"].replace("University", "copyright holder"): "bsd-3-clause",
    }
    names = list(cases.items())
    frame = spark.createDataFrame([(i, f"Some words before.\n{t}\nand words after") for i, (t, _) in enumerate(names)], "doc_id int, text string")
    found = licenses.license_scan(frame, licenses.known_licenses(spark), mark_col="mark").collect()
    got = {r["doc_id"]: sorted({m["license"] for m in r["licenses"]}) for r in found}
    assert {t[:90]: got[i] for i, (t, _) in enumerate(names)} == {t[:90]: [n] if n else [] for t, n in names}


def test_windows_that_differ_in_few_bits_are_kept_apart():
    """Windows around one short window whose hashes agree in their low 40 bits, or whose hashes and places add up alike."""
    doc, place, short = np.arange(4), np.zeros(4, np.int64), np.full(4, 77, np.uint64)
    long = np.array([5, 5 + (1 << 40), 4, 5], np.uint64)
    offset = np.array([3, 3, 4, 3])
    pieces = [b for b in substrings._pack(np.zeros(4, np.int32), doc, place, long, short, offset)]
    found = [r for b in substrings._repeats(iter(pieces)) for r in b.to_pylist()]
    assert found == [{"doc": 3, "start": 0, "stop": 1}]
    again = substrings._settle(doc, place, np.full(4, 9, np.uint64), np.array([1, 2, 1, 3], np.uint64))
    assert dict(zip(again[0].tolist(), again[1].tolist())) == {0: False, 2: True, 1: False, 3: False}


def test_packed_windows_come_back():
    doc = np.array([-5, -5, 3, 1 << 40, (1 << 40) + 70_000])
    place = np.array([0, 300, 70_000, 5, 6])
    long, short = np.arange(5).astype(np.uint64), np.arange(5).astype(np.uint64)
    for batch in substrings._pack(np.zeros(5, np.int32), doc, place, long, short, np.zeros(5, np.int64)):
        for row in batch.to_pylist():
            assert [x.tolist() for x in substrings._unpack(row)] == [doc.tolist(), place.tolist(), [1] * 5]


def test_short_templates_are_found_without_bands():
    """One band misses most windows; templates of up to four words are found all the same."""
    texts = pa.array([" ".join([f"a{i}", f"b{i}", f"c{i}", *["all rights reserved"] * (i % 2), f"d{i}", "twice over", "so it ends here", f"e{i}"]) for i in range(200)])
    short = licenses.Templates([("r", "All rights reserved.", None), ("t", "twice over", None), ("s", "so it ends here", None)], 3, 1)
    for i, found in enumerate(licenses._find(texts, short, 0.8)):
        assert sorted(m["license"] for m in found) == ["r"] * (i % 2) + ["s", "t"]
