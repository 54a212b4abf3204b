"""The corpus pipeline: every stage against brute force on what its predecessor kept."""

import collections
import random
import re

import pytest

import corpus_pipeline
from reelgrid.llm import simhash
from reelgrid.llm.shared import pin

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = pin(stage(spark, docs, FOLDER))
        assert docs.columns[: len(columns)] == columns
        assert n == 4 or docs.columns == columns
        kept.append(docs.collect())
    return kept


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near-duplicates", "benchmark decontamination", "mixing", "sharding",
    ]


def test_quality_keeps_good_documents(spark, stages):
    labels = dict(spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality").collect())
    kept = {r["doc_id"] for r in stages[1]}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in bad) <= 0.3 * len(bad)


def five_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_stays(stages):
    sets = {r["doc_id"]: five_words(r["text"]) for r in stages[1]}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and group[i] != group[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert len(set(group.values())) < len(sets)
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(set(group.values()))


def test_a_repeated_line_hides_no_copy(spark):
    # sets of shingles hardly differ, however often a line stands in one copy
    draw, rows = random.Random(4), []
    for n in range(50):
        words = [f"w{draw.randrange(5000)}" for _ in range(150)]
        line = [f"r{draw.randrange(5000)}" for _ in range(6)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words + line * 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.one_of_each_group(spark, docs, FOLDER).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 100, 2))


@pytest.mark.parametrize("tree", [1024, 8])
def test_near_copies_go(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    draw, texts = random.Random(3), []
    for _ in range(30):
        words = [f"w{draw.randrange(5000)}" for _ in range(150)]
        for edits in (0, 1, 2, 3, 5, 7, 12):
            texts.append(" ".join(f"x{draw.randrange(99)}" if i in draw.sample(range(150), edits) else w for i, w in enumerate(words)))
    texts += [texts[0], texts[0].upper(), "", "   ", "two words", "Two  words"]
    base = texts[0].split()
    for n in range(40):  # a crowded group
        texts.append(" ".join([*base[:-1], f"end{n}"]))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = corpus_pipeline.one_of_each_group(spark, docs, FOLDER).collect()
    assert sorted(r["doc_id"] for r in left) == sorted(set(group))


def test_no_benchmark_is_left(spark, stages):
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = set()
    for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = cut(row["text"])
        phrases |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(p) for p in phrases}
    dirty = lambda w: any(tuple(w[i : i + n]) in phrases for n in sizes for i in range(len(w) - n + 1))
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(r["doc_id"] for r in stages[2] if not dirty(cut(r["text"])))


def test_mix_nears_its_targets(stages):
    size, taken = collections.Counter(), collections.Counter()
    for kept, count in ((stages[3], size), (stages[4], taken)):
        for r in kept:
            count[r["source"]] += len(r["text"].split())
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(size))}
    share = sum(size.values()) / sum(weights.values())
    for source in size:
        target = min(3 * size[source], weights[source] * share)
        assert taken[source] == pytest.approx(target, rel=0.25)
    assert set(map(tuple, stages[4])) <= set(map(tuple, stages[3]))


def test_shards_hold_the_mix(stages):
    assert collections.Counter(tuple(r)[:5] for r in stages[5]) == collections.Counter(map(tuple, stages[4]))
    counts = collections.Counter(r["shard"] for r in stages[5])
    assert sorted(counts) == list(range(16)) and max(counts.values()) - min(counts.values()) <= 1
