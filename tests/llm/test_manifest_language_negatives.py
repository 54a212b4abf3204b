"""The manifest, language identification and hard negatives: brute force, edge cases and small blocks."""

import hashlib
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.llm import crossparse, merkle, queries, segments

FOLDER = "/root/testdata/sf0.001"


# manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive_manifest(rows, order):
    """Leaf, sub-root, root, siblings by the definition; ``rows`` are (source, key, leaf)."""
    by = {}
    for source, key, leaf in rows:
        by.setdefault(source, []).append((key is not None, key, leaf))

    def up(level):
        levels = [level]
        while len(levels[-1]) > 1:
            row = levels[-1]
            levels.append([sha("".join(row[i : i + 3])) for i in range(0, len(row), 3)])
        return levels

    def beside(levels, i):
        found = []
        for row in levels[:-1]:
            run = i // 3 * 3
            found += [row[j] for j in range(run, min(run + 3, len(row))) if j != i]
            i //= 3
        return found

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([leaf for *_, leaf in sorted(by[s], key=lambda r: (r[0], r[1] or 0, r[2]))]) for s in sources}
    top = up([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for i, leaf in enumerate(trees[s][0]):
            out.append((leaf, trees[s][-1][0], top[-1][0], beside(trees[s], i) + beside(top, n)))
    return sorted(out)


@pytest.mark.parametrize("levels", range(1, 8))
def test_layout_is_van_emde_boas(levels):
    places = [merkle.address(levels, d, np.arange(3**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_of(levels)))
    # every lower tree of the first split is one run of places, laid out like any tree of its height
    upper = levels // 2
    if upper:
        size = merkle.nodes_of(levels - upper)
        for tree in range(3**upper):
            own = [places[d][tree * 3 ** (d - upper) : (tree + 1) * 3 ** (d - upper)] for d in range(upper, levels)]
            begin = merkle.nodes_of(upper) + tree * size
            assert [(o - begin).tolist() for o in own] == [merkle.address(levels - upper, d, np.arange(3**d)).tolist() for d in range(levels - upper)]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_by_definition(spark, height):
    rows = [(i, "a" if i < 60 else f"s{i % 13}" if i < 90 else None, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    leaf = {i: sha(f"{len(str(i))}:{i}{len(t)}:{t}") for i, _, t in rows}
    made = merkle.manifest(docs, ["doc_id", "text"], "source", "doc_id", height=height).prove().collect()
    assert {r["doc_id"]: r["leaf"] for r in made} == leaf
    got = sorted((r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in made)
    assert got == naive_manifest([(s, i, leaf[i]) for i, s, _ in rows], None)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in made)


def test_manifest_edges(spark):
    long = "é" * 200_000
    rows = [
        (None, None, None, "x"), (None, None, None, "x"), (1, "", "", "x"), (1, "", "", "x"), (2, "é", long, "x"), (3, "b", "a\nb", "x"),
        (4, "b", "ab", "x"), (5, "b", None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, root string")
    now = [F.col("doc_id"), F.replace("text", F.lit("\n"), F.lit(""))]
    made = merkle.manifest(docs, ["doc_id", "text"], "source", "doc_id", claim=now)
    proven = made.prove().collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [sha(field(i) + field(t)) for i, _, t, _ in rows]
    assert sorted((r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in proven) == naive_manifest(
        [(s, i, leaf) for (i, s, _, _), leaf in zip(rows, leaves)], None
    )
    assert {r["doc_id"] for r in proven if not r["verified"]} == {3}
    assert made.subroots().count() == 4
    one = merkle.manifest(docs.filter("doc_id = 2"), ["text"], "source", "doc_id")
    assert one.root() == sha(field(long)) and one.prove().first()["siblings"] == []
    none = merkle.manifest(docs.limit(0), ["text"], "source", "doc_id")
    assert none.root() is None and none.prove().count() == 0


# language


def naive_language(text, samples, alphabet):
    """The language by counting greedy phrases with substring search."""
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    text = " " + " ".join(words.split(" ")) if words.strip(" ") else ""
    text = re.sub(" +", " ", text).rstrip(" ")
    if not text:
        return "und", {}
    cost = {}
    for lang, sample in samples.items():
        phrases = 0
        for start in range(0, len(text), crossparse.STRETCH):
            part, i = text[start : start + crossparse.STRETCH], 0
            while i < len(part):
                n = 1
                while i + n < len(part) and part[i : i + n + 1] in sample:
                    n += 1
                i, phrases = i + n, phrases + 1
        cost[lang] = phrases * math.log2(len(sample) + crossparse.FIRST + alphabet) / len(text)
    return min(sorted(cost), key=cost.get), cost


def spelt(model_numbers, letters):
    back = {int(model_numbers[c]): chr(c) for c in np.flatnonzero(model_numbers >= crossparse.FIRST)}
    return "".join({crossparse.GAP: " ", crossparse.BORDER: "\0"}.get(v) or back[v] for v in letters.tolist())


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    return docs, crossparse.fit(docs, learn=F.col("doc_id") % 3 != 0)


def test_language_by_substrings(spark, monkeypatch, languages):
    monkeypatch.setattr(crossparse, "SAMPLE", 1500)
    samples = {}
    plain = crossparse.sample_of

    docs, _ = languages
    rows = docs.filter("doc_id % 3 != 0").toPandas()
    parts, alphabet = [], np.array(sorted({ord(c) for t in rows["text"] for c in t.lower() if crossparse._letters()[ord(c)] and c < "ß"}))
    numbers = crossparse.numbered(alphabet)
    for lang, own in rows.groupby("lang"):
        own = own.assign(rank=np.arange(len(own)), piece=own["text"].str[:300], inner=np.arange(len(own)) % 2 == 1)
        # letters that only one sample has stand for themselves; the naive version searches the spelt sample
        letters = plain(own, numbers)
        letters = letters[letters != crossparse.UNKNOWN]
        samples[lang] = spelt(numbers, letters)
        parts.append((lang, len(letters), *crossparse.packed(*crossparse.automaton(letters.tolist()), crossparse.FIRST + len(alphabet))))
    model = crossparse.Model.of(alphabet, parts)
    texts = [*docs.toPandas()["text"].tolist()[:40], None, "", " 12 ", "ﬀ ß Ж", "a", "the" * 2000]
    names, sure = model.predict(texts, model.numbers())
    for text, name, s in zip(texts, names, sure):
        want, cost = naive_language(text or "", samples, len(alphabet))
        assert name == want
        if cost:
            n = len(crossparse.spell([text], numbers)[0])
            assert math.isclose(s, 1 / sum(2 ** -min((c - min(cost.values())) * min(n, crossparse.SURE), 60) for c in cost.values()))
        else:
            assert s == 0


def test_automaton_accepts_passages_only():
    letters = [int(c) for c in "3434354433453433"]
    base, owner, to = crossparse.packed(*crossparse.automaton(letters), 6)
    text = "".join(map(str, letters))
    for n in range(1, 7):
        for value in range(3**n):
            word = [3 + value // 3**i % 3 for i in range(n)]
            state, alive = 0, True
            for c in word:
                slot = base[state] + c
                alive = alive and owner[slot] == state
                state = to[slot]
            assert alive == ("".join(map(str, word)) in text)


def test_language_of_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op11_crossparse"](spark, folder).collect()
    lang = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect())
    assert {r["doc_id"] for r in rows} == set(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) >= 0.98 * len(held)


def test_language_edges(spark, languages):
    docs, model = languages
    long = "the and of " * 300_000
    rows = [(1, None, "x"), (None, "", "x"), (3, " 1 2 \n", "x"), (4, long, "x"), (4, long, "x"), (5, "語" * 5000, "x"), (6, "퟿" + "é", "x")]
    found = crossparse.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    rows = found.collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and [r["score"] for r in rows[:3]] == [0.0] * 3
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == "en"
    assert rows[5]["lang_pred"] in model.languages
    empty = docs.limit(0)
    assert crossparse.predict(empty, model).count() == 0
    nothing = crossparse.fit(empty)
    assert {tuple(r) for r in crossparse.predict(docs, nothing).select("lang_pred", "score").collect()} == {("und", 0.0)}
    untold = crossparse.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert untold.languages == []
    mute = crossparse.fit(spark.createDataFrame([(1, "12", "xx"), (2, "ab ba", "yy")], "doc_id long, text string, lang string"))
    assert mute.languages == ["yy"]


# hard negatives


def naive_negatives(rows, anchors, positives=5, negatives=3):
    """``rows`` are (id, label, whole numbers)."""
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, label, v in rows:
        if i not in anchors:
            continue
        scored = sorted(((-dot(v, w), j, other) for j, other, w in rows if j != i), key=lambda s: s[:2])
        for score, j, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(-s, k) for s, k, other in scored if other != label and 50 * -score <= 100 * -s <= 95 * -score]
            out += [(i, j, n, k, -score, s) for n, (s, k) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def vectors(draw, count, dims):
    kinds = draw.normal(0, 0.2, (6, dims)) + 0.1
    return [(i, int(draw.integers(0, 4)), (kinds[draw.integers(0, 6)] + draw.normal(0, 0.05, dims)).tolist()) for i in range(count)]


@pytest.mark.parametrize(("block", "asked", "seed"), [(8192, 256, 4096), (16, 8, 10), (40, 7, 5)])
def test_negatives_by_definition(spark, monkeypatch, block, asked, seed):
    for name, value in (("BLOCK", block), ("ASKED", asked), ("SEED", seed)):
        monkeypatch.setattr(segments, name, value)
    draw = np.random.default_rng(4)
    rows = vectors(draw, 300, 10)
    # ties: a common vector under several labels
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").repartition(5)
    got = sorted(tuple(r) for r in segments.hard_negatives(df, F.expr("vec_id % 10 = 0")).collect())
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    assert got == naive_negatives(whole, {i for i, *_ in rows if i % 10 == 0})
    assert len({r[0] for r in got}) > 10


@pytest.mark.parametrize("dense", [0, 1 / 16, 1])
def test_survivors_hold_all_that_matter(monkeypatch, dense):
    monkeypatch.setattr(segments, "DENSE", dense)
    draw = np.random.default_rng(3)
    q, x = np.floor(draw.normal(3, 90, (30, 50))), np.floor(draw.normal(-2, 70, (200, 50)))
    exact, apart = q @ x.T, draw.random((30, 200)) < 0.7
    a, n, s = segments.surviving(
        [segments.summary(q, level) for level in segments.LEVELS], [segments.summary(x, level) for level in segments.LEVELS],
        lambda a, n, dense: exact[a, n], lambda a, lower, upper: (upper >= 1000) & (lower <= 3000), apart,
    )
    assert (s == exact[a, n]).all()
    matter = {p for p in zip(*map(np.ndarray.tolist, np.nonzero(apart & (exact >= 1000) & (exact <= 3000))))}
    found = set(zip(a.tolist(), n.tolist()))
    assert matter <= found and len(found) < apart.sum()


def test_bounds_hold():
    draw = np.random.default_rng(2)
    q, x = np.floor(draw.normal(3, 90, (30, 50))), np.floor(draw.normal(-2, 70, (200, 50)))
    exact, width = q @ x.T, np.inf
    for level in segments.LEVELS:
        lower, upper = segments.bounds(segments.summary(q, level), segments.summary(x, level))
        assert (lower <= exact).all() and (exact <= upper).all()
        assert (upper - lower).mean() < width
        width = (upper - lower).mean()


@pytest.mark.parametrize("dims", [1, 3, 10, 33, 50, 64])
def test_coarser_summaries_hold(dims):
    draw = np.random.default_rng(dims)
    q, x = np.floor(draw.normal(3, 90, (20, dims))), np.floor(draw.normal(-2, 70, (60, dims)))
    q[0], x[0], x[1] = 7, -9, 0
    stored = [tuple(a.astype(np.float32).astype(np.float64) for a in segments.summary(v, segments.LEVELS[-1])) for v in (q, x)]
    for level in segments.LEVELS:
        lower, upper = segments.bounds(*(segments.coarser(fine, dims, level) for fine in stored))
        assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()
        for fine, v in zip(stored, (q, x)):
            for got, want in zip(segments.coarser(fine, dims, level), segments.summary(v, level)):
                assert np.allclose(got, want, rtol=1e-3, atol=2e-3 * np.abs(v).max() * np.sqrt(dims))


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0], "x"), (1, 1, [1.0, 0.1], "x"), (2, 2, [0.8, 0.0], "x"), (3, 2, [0.8, 0.0], "x"), (4, None, [0.8, 0.0], "x"),
        (5, 2, None, "x"), (6, 2, [None, 0.8], "x"), (7, 2, [nan, 0.8], "x"), (8, 2, [inf, 0.8], "x"), (None, 2, [0.8, 0.0], "x"),
        (9, 2, [], "x"), (11, 2, [0.8], "x"), (12, 3, [-1.0, 0.0], "x"), (10, 3, [0.0, 0.0], "x"), (20, 4, [1.0, 1.0], "x"),
    ]
    shape = "vec_id long, label int, vector array<double>, score string"
    df = spark.createDataFrame(rows, shape)
    got = sorted(tuple(r) for r in segments.hard_negatives(df, F.expr("vec_id % 10 = 0")).collect())
    whole = [(i, n, [math.floor(256 * x) for x in v]) for i, n, v, _ in rows if i in (0, 1, 2, 3, 9, 10, 11, 12, 20)]
    assert got == naive_negatives(whole, {0, 10, 20})
    assert [r[3] for r in got if r[0] == 0] == [2, 3, 11]
    assert segments.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert segments.hard_negatives(df, F.lit(False)).count() == 0
    assert segments.hard_negatives(df.filter("vec_id is null"), F.lit(True)).count() == 0
    twice = df.filter("vec_id < 4").union(df.filter("vec_id = 0"))
    assert sorted(r["anchor_id"] for r in segments.hard_negatives(twice, F.expr("vec_id = 0")).collect()) == [0, 0, 0, 0]
