"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import numpy as np
import pytest

from reelgrid.llm import backoff, chat, decontam, fmindex, interleave, mixing, quality, simhash, toxicity, vafile
from reelgrid.llm.components import components
from reelgrid.llm.sampling import held_out

DOCS = "doc_id long, text string, source string, n_chars long, shard string, score string, items string, size string, _row string"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "The same words in both of these texts here", "a", 10),
        (2, "The same words in both of these texts here", "a", None),
        (2, "The same words in both of these texts here", "a", None),
        (3, None, None, None),
        (4, "", "b", 0),
        (None, "no id at all", None, 3),
        (None, None, None, None),
        (5, long, "b", len(long)),
        (6, "one", "c", 3),
        (7, " \t\n ", "c", -4),
    ]
    return spark.createDataFrame([r + ("x",) * 5 for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_near_duplicates(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 10
    by = lambda i: [(r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"] == i]
    assert by(1)[0] == by(2)[0] == by(2)[1] and by(1)[0][1] == 1
    assert by(3) == by(4) == by(7) == [("0" * 16, 3)]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicated(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 3, 5, 6]
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id at all"]
    assert kept[0].__fields__ == docs.columns
    assert simhash.deduplicated(none).count() == 0


def test_forest_finds_all_pairs():
    draw = np.random.default_rng(1)
    values = np.unique(draw.integers(0, 1 << 12, 700).astype(np.uint64) | (draw.integers(0, 3, 700).astype(np.uint64) << np.uint64(60)))
    groups = (values >> np.uint64(60)).astype(np.int64)
    forest = simhash.Forest(values, groups)
    roots = forest.roots[np.searchsorted(groups[forest.roots], groups)]
    query, node = forest.near(values, roots, 4)
    found = set(zip(query.tolist(), node.tolist()))
    for i in range(len(values)):
        near = np.flatnonzero((np.bitwise_count(values ^ values[i]) <= 4) & (groups == groups[i]))
        assert {(i, j) for j in near.tolist()} == {p for p in found if p[0] == i}


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", 16)
    draw = np.random.default_rng(2)
    flips = [sum(1 << int(b) for b in draw.choice(64, 3, replace=False)) for _ in range(150)]
    values = sorted({(0x0123456789ABCDEF ^ f) for f in flips})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    root = {r["node"]: r["root"] for r in components(found).collect()}
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    want = [min(signed[j] for j in range(len(values)) if group[j] == group[i]) for i in range(len(values))]
    assert [root.get(v, v) for v in signed] == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (102, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {102: 101}


def test_chat(spark):
    tricky = "<|end|>\\<|turn|>\\\\ <\\| é😀 <"
    rows = [
        (1, 0, "assistant", tricky, "x"), (1, 1, None, None, "x"), (1, 1, "assistant", "", "x"),
        (None, None, "assistant", "a", "x"), (None, None, "assistant", "a", "x"), (2, 0, "user<|text|>", "b", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    pieces = chat.format_conversations(turns)
    assert all(len(r["token_ids"]) == len(r["loss"]) == len(r["starts"]) for r in pieces.collect())
    got = {r["conv_id"]: r for r in chat.read_back(pieces).collect()}
    assert {c: (r["n_turns"], r["loss_chars"]) for c, r in got.items()} == {1: (3, len(tricky)), None: (2, 2), 2: (1, 0)}
    assert chat.format_conversations(turns.limit(0)).count() == 0
    assert chat.unescape(chat.escape(tricky)) == tricky and "<|" not in chat.escape(tricky)


def test_long_conversations_go_on_in_pieces(spark, monkeypatch):
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"turn {i} " * 9) for i in range(50)], "conv_id long, turn int, role string, text string")
    whole = chat.read_back(chat.format_conversations(turns)).collect()
    tokens = [t for r in chat.format_conversations(turns).collect() for t in r["token_ids"]]
    monkeypatch.setattr(chat, "PIECE", 200)
    pieces = chat.format_conversations(turns)
    rows = sorted(pieces.collect(), key=lambda r: r["piece"])
    assert len(rows) > 5 and [t for r in rows for t in r["token_ids"]] == tokens
    assert chat.read_back(pieces).collect() == whole


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifiers(spark, docs, none, kind):
    label = "quality" if kind is quality else "toxic"
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (6, 0), (None, 1), (5, None)], f"doc_id long, {label} int")
    for given, sample in ((labels, docs), (labels.limit(0), docs), (labels, none)):
        model = kind.fit(sample, given)
        rows = kind.score(docs, model).collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
        assert rows[0].__fields__ == [c for c in docs.columns if c != "score"] + ["score"]
    assert kind.score(none, model).count() == 0


def test_misspellings_share_subwords(spark):
    draw = np.random.default_rng(4)
    fill = ["tree", "house", "river", "walk", "green", "stone"]
    texts = [" ".join(draw.choice(fill, 12)) for _ in range(400)]
    bad = ["blorgish", "blorgisher", "blorgishly"]
    texts = [t + " " + bad[i % 3] if i % 2 else t for i, t in enumerate(texts)]
    model = toxicity.train(texts, np.arange(400) % 2, np.ones(400))
    odds = model.log_odds(["tree blorgishes walk", "tree stones walk", ""], {})
    assert odds[0] > 0 > odds[1] and odds[2] < 0


def test_unspaced_runs_are_read_to_their_end(spark):
    draw = np.random.default_rng(4)
    vocabulary = ["".join(chr(97 + c) for c in draw.integers(0, 26, 6)) for _ in range(60)]
    some = lambda n: list(draw.choice(vocabulary, n))
    grams = lambda w: {w[i : i + n] for n in range(toxicity.SHORT, toxicity.LONG + 1) for i in range(len(w) - n + 1)}
    for n in (3, 50, 51, 57, 58, 59, 64, 65, 201, 1000):
        word = "".join(chr(0x4E00 + c) for c in draw.integers(0, 400, n))
        pieces = toxicity.words_of(word)
        assert grams(word) == set().union(*map(grams, pieces)) and max(map(len, pieces)) <= toxicity.LONGEST
        assert pieces[0][0] == word[0] and pieces[-1][-1] == word[-1]
    text = lambda i, glue: glue.join(some(60) + ["vilescum"] * (i % 2) + some(3))
    y = np.arange(200) % 2
    # learnt from texts that are one word each, with what is toxic behind 400 characters
    odds = toxicity.train([text(i, "_") for i in range(200)], y, np.ones(200)).log_odds([text(i, "_") for i in range(200)], {})
    assert (odds[y == 1][:, None] > odds[y == 0]).mean() > 0.9
    model = toxicity.train([text(i, " ") for i in range(200)], y, np.ones(200))
    plain = ["_".join(some(1500)) for _ in range(10)]
    assert min(map(len, plain)) > 10_000
    clean, toxic = model.log_odds(plain, {}), model.log_odds([f"{t}_vilescum" for t in plain], {})
    assert (toxic > clean + 0.5).all() and toxic.min() > clean.max()
    rows = spark.createDataFrame([(f"{t}_vilescum",) for t in plain], "text string")
    scores = [r["score"] for r in toxicity.score(rows, model).collect()]
    assert sorted(scores) == pytest.approx(sorted(1 / (1 + np.exp(-toxic))))


def test_mixing(docs, none):
    rows = mixing.mix(docs.withColumn("n", mixing.words_in("text")), size="n").collect()
    assert len(rows) == 10 and {r["n"] for r in rows} == {9, 0, 4, 60_000, 1}
    total = {}
    for r in rows:
        assert 0 <= r["copies"] <= 3 and r["source_size"] is not None
        total[r["source"]] = r["target"]
    assert total["a"] == 81 and total["c"] == 3 and total[None] == 12
    assert sum(total.values()) == pytest.approx(60_032)
    assert mixing.mix(none.withColumn("n", mixing.words_in("text")), size="n").count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_top_k(spark):
    v = [
        (0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.1, None]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]),
        (6, []), (7, [-1.0, -0.5]), (None, [1.0, 1.0]), (8, [1.0]),
    ]
    rows = spark.createDataFrame([(*r, "x") for r in v], "vec_id long, vector array<float>, score string")
    got = [tuple(r) for r in vafile.top_k(rows, rows.filter("vec_id = 0"), 5).collect()]
    assert sorted(got) == [(0, 1, 1, 256 * 256 + 128 * 128), (0, 2, 8, 256 * 256), (0, 3, 6, 0), (0, 4, 7, -(256 * 256 + 128 * 128))]
    assert vafile.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_top_k_sends_no_copies_of_the_queries_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 256)
    monkeypatch.setattr(vafile, "ASKED", 64)
    # parts of several blocks, scores that are equal in many of them, and vectors beyond single precision
    rows = spark.range(8000).selectExpr("id vec_id", "transform(sequence(1, 6), i -> cast(pmod(hash(id % 7000, i), 9) - 4 as double)) vector")
    for scale in (1.0, 2.0**20):
        found = vafile.top_k(rows, rows.filter("vec_id % 10 = 0"), 5, scale=scale)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        x = np.array([r["vector"] for r in rows.orderBy("vec_id").collect()]) * scale
        want = []
        for q in range(0, len(x), 10):
            score = (x @ x[q]).astype(np.int64)
            best = [i for i in np.lexsort((np.arange(len(x)), -score))[:6].tolist() if i != q][:5]
            want += [(q, n + 1, i, int(score[i])) for n, i in enumerate(best)]
        assert sorted(map(tuple, found.collect())) == want


def test_contaminated(spark, docs, none):
    items = spark.createDataFrame(
        [("i1", "same words in both"), ("i2", None), ("i3", "..."), (None, "one"), ("i1", "same words in both"), ("i5", "ONE")],
        "item_id string, text string",
    )
    rows = decontam.contaminated(docs, items).collect()
    assert len(rows) == 10
    for r in rows:
        want = (4, ["i1"]) if (r["text"] or "").startswith("The same") else (1, ["i5"]) if r["text"] == "one" else (0, [])
        assert (r["n_hit"], r["items"]) == want
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert sorted(r["doc_id"] or -1 for r in decontam.clean(docs, items).collect()) == [-1, -1, 3, 4, 5, 7]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x x omega x " + "x " * 40 + "omega")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "alpha omega x")], "item_id string, text string")
    windows = decontam.phrases(items, docs, 10)
    wanted = windows.selectExpr("explode(anchors.term) as term").distinct()
    found = decontam.near(decontam.index(docs, wanted), windows, 5).collect()
    assert [(r["from"], r["to"]) for r in found] == [(0, 4)]


@pytest.mark.parametrize("hot", [0, 256])
def test_repeats(spark, docs, none, monkeypatch, hot):
    monkeypatch.setattr(fmindex, "HOT", hot)
    rows = {r["doc_id"]: r for r in fmindex.remove_repeats(docs).collect()}
    assert rows[5]["n_words"] == 60_000 and rows[5]["n_removed"] == 60_000 - 977
    assert all(r["n_removed"] == 0 for i, r in rows.items() if i != 5)
    assert fmindex.remove_repeats(none).count() == 0
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(25))
    some = spark.createDataFrame([(2, f"x {a} y"), (1, f"{a} {b}"), (None, f"{b} z"), (3, b + " a0 a1"), (4, "a0 a1")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in fmindex.remove_repeats(some.repartition(3)).collect()}
    assert got == {1: (0, f"{a} {b}"), 2: (30, "x y"), 3: (25, "a0 a1"), 4: (0, "a0 a1"), None: (25, "z")}


def test_interleave(docs, none):
    rows = interleave.interleave(docs, 3).collect()
    assert len(rows) == 10 and rows[0].__fields__ == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, i) for i in range(4)] + [(s, i) for s in (1, 2) for i in range(3)]
    assert interleave.interleave(none).count() == 0


def test_backoff(docs, none):
    rows = backoff.score(docs, held_out(folds=7, fold=2)).collect()
    assert len(rows) == 10 and sum(r["n_tokens"] for r in rows) == 60_000 + 3 * 9 + 4 + 1 + 10
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert backoff.score(none, held_out(folds=7, fold=2)).count() == 0


def test_index_finds_first_places():
    draw = np.random.default_rng(6)
    for _ in range(40):
        text = draw.integers(0, int(draw.integers(2, 7)), int(draw.integers(40, 400)))
        text[-1] = 0
        depth = int(draw.integers(2, 7))
        index = fmindex.FMIndex(text, int(text.max()) + 1, depth)
        stops = np.flatnonzero(text == 0)
        begin = np.concatenate([[0], stops[:-1] + 1])
        words = stops - begin
        begin, words = begin[words > 0], words[words > 0]
        first, want = {}, []
        for b, n in zip(begin.tolist(), words.tolist()):
            want += [first.setdefault(tuple(text[p : p + depth].tolist()), p) for p in range(b, b + n - depth + 1)]
        assert index.matches(begin, words).tolist() == want


def test_ranks_of_a_wavelet_matrix():
    sequence = np.random.default_rng(7).integers(0, 11, 500).astype(np.int32)
    matrix = fmindex.WaveletMatrix(sequence, 11)
    places = np.arange(501, dtype=np.int32)
    for symbol in range(11):
        want = np.concatenate([[0], np.cumsum(sequence == symbol)])
        assert (matrix.rank(np.full(501, symbol, np.int32), places) == want).all()
