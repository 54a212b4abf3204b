"""The corpus queries over the supplied tables: against SQL where it can say it, else against brute force."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from reelgrid.llm import queries
from reelgrid.testing import compare, open_duckdb

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    return lambda sql: con.execute(sql.replace("@", f"{FOLDER}/")).fetchall()


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def rows(name, folder=FOLDER):
        if (name, folder) not in made:
            made[name, folder] = queries.QUERIES[name](spark, folder).collect()
        return made[name, folder]

    return rows


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    duck = open_duckdb(FOLDER)
    assert compare(queries.QUERIES[name](spark, FOLDER), duck, queries.ORACLES[name]) is None


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_near_duplicates(tables, result):
    docs = tables("select doc_id, text from '@documents.parquet' order by doc_id")

    def fingerprint(text):
        w = words(lower(text))
        parts = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t or "") for _, t in docs]
    group = {i: i for i, _ in docs}
    for n, (i, _) in enumerate(docs):
        for m in range(n):
            if (prints[n] ^ prints[m]).bit_count() <= 4:
                low, high = sorted((group[i], group[docs[m][0]]))
                group = {k: low if v == high else v for k, v in group.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result("op1_simhash")}
    assert got == {i: (f"{p:016x}", group[i]) for (i, _), p in zip(docs, prints)}


def test_chat(tables, result):
    said = collections.defaultdict(list)
    for conv, role, text in tables("select conv_id, role, coalesce(text, '') from '@conversations.parquet' order by conv_id, turn"):
        said[conv].append((role, text))
    trap = "\\### Assistant: </turn> ok"
    said[-7] = [("user", trap), ("assistant", trap)]
    got = {r["conv_id"]: r for r in result("op2_chat")}
    assert got.keys() == said.keys()
    for conv, turns in said.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row["formatted_chars"] > len(whole)


@pytest.mark.parametrize("name, label, least", [("op3_quality", "quality", 0.95), ("op7_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(result, name, label, least):
    folder = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"select doc_id, {label} from '{folder}/labels.parquet'").fetchall())
    rows = result(name, folder)
    assert len(rows) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) >= least


def test_mixing(tables, result):
    docs = {i: (s, len(words(t or ""))) for i, s, t in tables("select doc_id, source, text from '@documents.parquet'")}
    size = collections.Counter()
    for source, n in docs.values():
        size[source] += n
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(size))}
    target, stopped = {}, set()
    while True:  # hand out, stop the sources above their limit, hand out again
        rest = sum(size.values()) - sum(3 * size[s] for s in stopped)
        share = rest / sum(weight[s] for s in size if s not in stopped)
        over = {s for s in size if s not in stopped and weight[s] * share > 3 * size[s]}
        if not over:
            break
        stopped |= over
    target = {s: 3 * size[s] if s in stopped else weight[s] * share for s in size}
    taken = collections.Counter()
    rows = result("op4_mixing")
    assert len(rows) == len(docs)
    for r in rows:
        source, n = docs[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, size[source])
        assert r["target"] == pytest.approx(target[source], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * n and (n == 0 or r["taken"] % n == 0)
        taken[source] += r["taken"]
    largest = collections.defaultdict(int)
    for source, n in docs.values():
        largest[source] = max(largest[source], n)
    for source in size:
        assert abs(taken[source] - target[source]) <= 0.5 * largest[source], source
    assert abs(sum(taken.values()) / sum(target.values()) - 1) < 0.01


def test_mixing_reruns_agree(spark, result):
    assert sorted(queries.QUERIES["op4_mixing"](spark, FOLDER).collect()) == sorted(result("op4_mixing"))


def test_interleave(tables, result):
    docs = {i: (s, t) for i, s, t in tables("select doc_id, source, text from '@documents.parquet'")}
    rows = result("op9_interleave")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots = collections.defaultdict(list)
    mixture = collections.defaultdict(collections.Counter)
    for r in rows:
        source, text = docs[r["doc_id"]]
        raw = (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
        mixture[source][r["shard"]] += 1
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for counts in mixture.values():  # a contiguous stretch of the fractional ranks takes its share, give or take one
        share = sum(counts.values()) / 16
        assert all(abs(counts[s] - share) <= 2 for s in range(16))


def test_backoff(tables, result):
    docs = {i: lower(t or "").encode().split() + [b"\n"] for i, t in tables("select doc_id, text from '@documents.parquet'")}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    single, pairs = collections.Counter(), collections.Counter()
    for i, tokens in docs.items():
        if not held[i]:
            single.update([b" ", *tokens])
            pairs.update(zip([b" ", *tokens], tokens))
    kinds, total = len(single) - 1, sum(single.values()) - single[b" "]
    follow = collections.Counter(a for a, _ in pairs)
    ones, twos = (sum(n == k for n in pairs.values()) for k in (1, 2))
    d = min(max(ones / (ones + 2 * twos), 0.1), 0.9)
    alone = lambda w: (single[w] + 1) / (total + kinds + 1)
    both = lambda a, b: (max(pairs[a, b] - d, 0) + d * follow[a] * alone(b)) / single[a] if single[a] else alone(b)
    for word in (b" ", b"the", b"of"):  # all that can follow sums to one, the unknown included
        spread = sum(both(word, b) for b in single if b != b" ") + both(word, b"\0unknown")
        assert spread == pytest.approx(1)
    rows = {r["doc_id"]: r for r in result("op10_backoff")}
    assert rows.keys() == docs.keys()
    for i, tokens in docs.items():
        r = rows[i]
        known = sum(single[w] > 0 for w in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), known, total)
        assert r["base_score"] == pytest.approx(sum(math.log10(alone(w)) for w in tokens))
        assert r["score"] == pytest.approx(sum(math.log10(both(a, b)) for a, b in zip([b" ", *tokens], tokens)))
    assert sum(rows[i]["score"] for i in docs if held[i]) > sum(rows[i]["base_score"] for i in docs if held[i])
    assert np.isfinite([r["score"] for r in rows.values()]).all()
