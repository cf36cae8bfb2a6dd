import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.compare import compare, oracle
from netresil.llm import alignment, merge_automaton, treap
from netresil.llm.queries import ORACLE, QUERIES
from tests.llm import brute
from tests.llm.test_text_operators import COLUMNS, LONG, ODD

SF = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ADDED = [("special <|endoftext|>text<|endoftext|>",), ("a  b   c \n\n d \t ",), ("under▁score",), ("0x0A <0x0A> <s></s><unk>\x00",), ("-" * 700,), ("x" + " \n" * 6000 + "y",), ("東京 ́é🎉 ẍ",), (" ",), ("'s'S I'll  don't",)]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(ODD, COLUMNS).withColumn("ids", F.lit("x")).withColumn("n_a", F.lit("x")).unionByName(
        spark.createDataFrame(ADDED, "text string"), allowMissingColumns=True)


def merged(word, merges):
    """Merging in order of rank, each from the left."""
    word = list(word)
    for u, v, joined in merges:
        out = []
        for t in word:
            if out and out[-1] == u and t == v:
                out[-1] = joined
            else:
                out.append(t)
        word = out
    return word


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_automaton_takes_the_one_path_of_merging_by_rank(data):
    labels, merges = [b"a", b"b", b"c"], []
    for _ in range(data.draw(st.integers(0, 12))):
        u, v = (data.draw(st.integers(0, len(labels) - 1)) for _ in range(2))
        if labels[u] + labels[v] not in labels:
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
    words = merge_automaton.Words(labels, merge_automaton.MergeAutomaton([0, 1, 2], merges))
    for _ in range(5):
        word = data.draw(st.text("abc", max_size=24))
        assert words.encode(word) == merged(["abc".index(c) for c in word], merges)


def test_two_merges_for_one_token_are_refused():
    with pytest.raises(ValueError):
        merge_automaton.MergeAutomaton([0, 1], [(0, 1, 2), (0, 1, 2)])


def test_tokenizers_of_other_kinds_are_refused(tmp_path):
    with pytest.raises(ValueError):
        merge_automaton.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_encode_and_decode_match_the_library(spark, texts, library):
    encoded = merge_automaton.encode(texts, BYTES)
    assert encoded.columns == [*(c for c in texts.columns if c != "ids"), "ids"]
    for row in merge_automaton.decode(encoded, BYTES).select("text", "ids", "decoded").collect():
        expected = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == expected
        assert row.decoded == library.decode(expected, skip_special_tokens=False) == (row.text or "")
    plainly = merge_automaton.encode(texts.where("text like '%endoftext%'"), BYTES, specials=False).first()
    assert 50256 not in plainly.ids


def test_decode_of_any_ids_matches_the_library(spark, library):
    r = random.Random(5)
    cases = [[r.randrange(50257) for _ in range(r.randrange(40))] for _ in range(60)] + [[r.randrange(256) for _ in range(30)] for _ in range(60)]
    made = spark.createDataFrame([(i, c) for i, c in enumerate(cases)] + [(900, None), (901, [None, 64, 99999999, -1])], "doc_id int, ids array<int>")
    got = {row.doc_id: row.decoded for row in merge_automaton.decode(made, BYTES).collect()}
    assert all(got[i] == library.decode(c, skip_special_tokens=False) for i, c in enumerate(cases))
    assert got[900] == "" and got[901] == library.decode([64])
    assert merge_automaton.decode(spark.createDataFrame([([50256, 64],)], "ids array<int>"), BYTES, skip_specials=True).first().decoded == library.decode([64])


def test_forgetting_pieces_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(merge_automaton, "REMEMBERED", 3)
    monkeypatch.setattr(merge_automaton, "JUDGED", 2)
    tokenizer = merge_automaton.Tokenizer(BYTES)
    for text in ("some words here and more words", "more words again", LONG[:500]):
        ids, edges = tokenizer.words().tokens([tokenizer.split(text, True)])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and edges.tolist() == [0, len(ids)]


def test_merge_automaton_query_on_whole_documents(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_merge_automaton"](spark, SF).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_alignment_matches_every_pair_of_tokens(spark, texts, plain):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    aligned = alignment.align(texts, BYTES, PIECES)
    scored = alignment.score_links(aligned, alignment.link_counts(aligned)).collect()
    expected = [brute.alignment(r.text, plain, model) for r in scored]
    count = Counter(pair for e in expected for pair in e["links"])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for row, e in zip(scored, expected):
        assert (row.n_a, row.n_b, row.n_overlaps) == (e["n_a"], e["n_b"], e["n_overlaps"]), row.text
        assert row.groups == brute.told(e["groups"]) and row.n_groups == len(e["groups"])
        assert [tuple(x) for x in row.links] == e["links"] and row.n_links == len(e["links"])
        assert row.n_best == sum(count[p] == best[p[1]] for p in e["links"])
        assert row.count_sum == sum(count[p] for p in e["links"])
    assert any(r.text and r.n_a == 0 for r in scored)  # a text one side does not spell


def test_links_under_other_counts(spark):
    rows = spark.createDataFrame([(1, [(1, 2), (3, 4)]), (2, None), (3, [])], f"doc_id int, links {alignment.LINKS}")
    counts = spark.createDataFrame([(1, 2, 7, True)], "a int, b int, n bigint, best boolean")
    got = [(r.n_links, r.n_best, r.count_sum) for r in alignment.score_links(rows, counts).orderBy("doc_id").collect()]
    assert got == [(2, 1, 7), (0, 0, 0), (0, 0, 0)]
    none = alignment.score_links(rows, counts.limit(0)).orderBy("doc_id").first()
    assert (none.n_links, none.n_best, none.count_sum) == (2, 0, 0)


def test_alignment_query_on_whole_documents(spark, plain):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    expected = {i: brute.alignment(t, plain, model) for i, t in texts.items()}
    count = Counter(pair for e in expected.values() for pair in e["links"])
    got = QUERIES["op12_alignment"](spark, SF).collect()
    assert len(got) == len(texts)
    for row in got:
        e = expected[row.doc_id]
        assert (row.n_a, row.n_b, row.n_groups, row.n_links) == (e["n_a"], e["n_b"], len(e["groups"]), len(e["links"]))
        assert row.groups_sha256 == (hashlib.sha256(brute.told(e["groups"]).encode()).hexdigest() if e["n_a"] else "")
        assert row.count_sum == sum(count[p] for p in e["links"])


def test_treap_search_matches_scoring_everything():
    r = np.random.default_rng(1)
    for _ in range(150):
        n_rows, n_docs, n, k = int(r.integers(1, 40)), int(r.integers(1, 70)), 5, 4
        row, doc = np.nonzero(r.random((n_rows, n_docs)) < r.random())
        impact = r.integers(1, r.choice([4, 1000]), len(row))
        grid = np.zeros((n_rows, n_docs), np.int64)
        grid[row, doc] = impact
        asked = [np.sort(r.choice(n_rows, r.integers(0, n_rows + 1), replace=False)) for _ in range(n)]
        items, rows = np.repeat(np.arange(n), [len(a) for a in asked]), np.concatenate(asked).astype(np.int64)
        weights, beat, tie = r.integers(1, 4, len(rows)), r.integers(0, 5, n), r.permutation(n_docs)
        expected = []
        for i in range(n):
            score = (grid[rows[items == i]] * weights[items == i][:, None]).sum(0)
            expected += [(i, t, -s) for s, t in sorted((-s, tie[d]) for d, s in enumerate(score) if s >= max(1, beat[i]))[:k]]
        got = treap.search(treap.build(row, doc, impact), items, rows, weights, n, k, beat.copy(), tie)
        assert list(zip(*(x.tolist() for x in got))) == expected


def test_treap_skips_what_cannot_come_first(monkeypatch):
    r = np.random.default_rng(2)
    doc = np.arange(4096)
    impact = np.where(doc < 10, 900, r.integers(1, 100, 4096))
    halved = []
    monkeypatch.setattr(treap, "_halve", lambda t, f, ranges, s, run=treap._halve: halved.append(len(ranges)) or run(t, f, ranges, s))
    got = treap.search(treap.build(np.zeros(4096, np.int64), doc, impact), np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64), 1, 10, np.zeros(1, np.int64), doc)
    assert got[1].tolist() == list(range(10)) and sum(halved) < 600


@pytest.mark.parametrize("limits", [{}, {"part_terms": 5, "block_docs": 3}])
def test_ranking_matches_brute_force(spark, texts, limits):
    items = spark.createDataFrame(
        [(1, "the cat ON the mat", 1), (2, None, 2), (3, "", 3), (None, "le chat", 4), (4, "?!", 5), (5, "same text twice over", 6), (5, "naïve 東京", 7), (6, "unheard", 8), (7, "w5 w6 the", 9)],
        "item_id int, text string, score int")
    got = treap.rank_documents(texts.repartition(3), items, **limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    expected = brute.ranking([(r.doc_id, r.text) for r in texts.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert Counter(map(tuple, got.collect())) == Counter(expected)


def test_ranking_of_empty_tables(spark, texts):
    items = spark.createDataFrame([(1, "the cat")], "item_id int, text string")
    assert treap.rank_documents(texts.limit(0), items).count() == 0
    assert treap.rank_documents(texts, items.limit(0)).count() == 0
    assert merge_automaton.decode(merge_automaton.encode(texts.limit(0), BYTES), BYTES).count() == 0
    none = alignment.align(texts.limit(0), BYTES, PIECES)
    assert alignment.score_links(none, alignment.link_counts(none)).count() == 0


def test_ranking_query_against_sql(spark):
    assert compare(QUERIES["op13_treap"](spark, SF), oracle(SF), ORACLE["op13_treap"]) == ""


def test_blocks_keep_to_their_bounds():
    batches = [pa.RecordBatch.from_pydict({"id": list(range(10)), "body": ["x" * 100] * 10}) for _ in range(3)]
    assert [b.num_rows for b in treap._blocks(batches, 1 << 20, 12)] == [10, 10, 10]
    assert [b.num_rows for b in treap._blocks(batches, 1 << 20, 20)] == [20, 10]
    assert sum(b.num_rows for b in treap._blocks(batches, 250, 1 << 20)) == 30
