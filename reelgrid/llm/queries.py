"""The corpus operators as named queries over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm import (
    backoff,
    chat,
    crossparse,
    decontam,
    fmindex,
    interleave,
    merkle,
    mixing,
    quality,
    segments,
    simhash,
    toxicity,
    vafile,
)
from reelgrid.llm.sampling import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint of every document and the group of near-duplicates it belongs to."""
    return simhash.near_duplicates(read(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])


@query("op2_chat")
def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    trap = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame(
        [(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn int, role string, text string"
    )
    given = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(given.unionByName(added)))


@query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "n_chars")
    model = quality.fit(docs, read(spark, folder, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_mixing")
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = read(spark, folder, "documents").select("doc_id", "source", mixing.words_in("text").alias("size"))
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query(
    "op5_vafile",
    """
    with ok as (
        select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
        from embeddings
        where embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
        select q.vec_id as query_id, c.vec_id,
               cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
        from ok q join ok c on q.vec_id <> c.vec_id
        where q.vec_id % 50 = 0
    ), ranked as (
        select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank
        from scored
    )
    select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
)
def op5_vafile(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors by inner product of every fiftieth vector."""
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return vafile.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, vector="embedding")


@query(
    "op6_decontam",
    r"""
    with docs as (
        select row_number() over () as r, doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from documents
    ), items as (
        select item_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from benchmark
    ), wins as (
        select item_id, least(len(w), 10) as n, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as s, w
        from items where len(w) > 0
    ), phrase as (select distinct item_id, n, array_to_string(w[s + 1 : s + n], ' ') as p from wins
    ), lens as (select distinct n from phrase
    ), places as (
        select r, n, unnest(range(0, len(w) - n + 1)) as s, w from docs, lens where len(w) >= n
    ), hits as (
        select r, s, x.n, x.item_id
        from (select r, n, s, array_to_string(w[s + 1 : s + n], ' ') as p from places) d join phrase x on d.n = x.n and d.p = x.p
    ), per as (
        select r, count(distinct spot) as n_hit from (select r, unnest(range(s, s + n)) as spot from hits) group by r
    ), named as (
        select r, count(distinct item_id) as n_items,
               sha256(array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',')) as items_sha256
        from hits group by r
    )
    select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
           coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
           coalesce(n_hit, 0) > 0 as contaminated
    from docs left join per using (r) left join named using (r)
    """,
)
def op6_decontam(spark: SparkSession, folder: str) -> DataFrame:
    """Which benchmark items every document holds, and how many of its words they cover."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, read(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, folder, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    "op8_fmindex",
    r"""
    with docs as (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
    ), wins as (
        select doc_id, unnest(range(1, greatest(len(w) - 18, 1))) as s, w from docs
    ), named as (
        select doc_id, s, hash(w[s : s + 19]) as h, w[s : s + 19] as p from wins
    ), repeated as (
        select doc_id, s from (select doc_id, s, row_number() over (partition by h, p order by doc_id, s) as n from named)
        where n > 1
    ), gone as (
        select distinct doc_id, unnest(range(s, s + 20)) as i from repeated
    ), words as (
        select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from docs
    ), kept as (
        select doc_id, string_agg(word, ' ' order by i) as kept from words anti join gone using (doc_id, i) group by doc_id
    ), removed as (select doc_id, count(*) as n_removed from gone group by doc_id)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
           sha256(coalesce(kept, '')) as kept_sha256
    from docs left join kept using (doc_id) left join removed using (doc_id)
    """,
)
def op8_fmindex(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document when passages that start earlier in the corpus are removed."""
    left = fmindex.remove_repeats(read(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_interleave")
def op9_interleave(spark: SparkSession, folder: str) -> DataFrame:
    """The shard and place of every document; counts of shards differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, folder, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleave.interleave(docs, 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_backoff")
def op10_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """The log-probability of every document."""
    return backoff.score(read(spark, folder, "documents").select("doc_id", "text"), held_out(folds=7, fold=2))


@query("op11_crossparse")
def op11_crossparse(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    outside = held_out(folds=4, fold=2)
    model = crossparse.fit(docs, learn=~outside)
    found = crossparse.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", outside.alias("held_out"), "lang_pred", "score")


@query(
    "op12_merkle",
    r"""
    with recursive docs as (
        select doc_id, source, lang, n_chars, text,
               list_reduce(
                   list_prepend(cast(4294967295 as bigint), list_transform(
                       string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
                   lambda a, b: list_reduce(
                       list_prepend(xor(a, b), [cast(0 as bigint) for _ in range(8)]),
                       lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))) & 1 = 1 as tampered
        from documents
    ), spelt as (
        select *,
               coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-')
               || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
               || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head,
               case when tampered then replace(text, chr(10), '') else text end as now
        from docs
    ), leaves as (
        select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
               sha256(head || coalesce(strlen(now) || ':' || now, '-')) as claim,
               row_number() over (partition by source order by doc_id) - 1 as spot,
               count(*) over (partition by source) as n
        from spelt
    ), tree as (
        select source, 0 as level, spot, n, leaf as node from leaves
        union all
        select source, level + 1, spot // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' order by spot))
        from tree where n > 1 group by source, level, spot // 3
    ), subroots as (
        select source, node as subroot, level as height,
               row_number() over (order by source nulls first) - 1 as spot, count(*) over () as n
        from tree where n = 1
    ), upper as (
        select 0 as level, spot, n, subroot as node from subroots
        union all
        select level + 1, spot // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' order by spot))
        from upper where n > 1 group by level, spot // 3
    ), whole as (select node as root from upper where n = 1
    ), nodes as (
        select coalesce('s' || source, '') as key, level, spot, node from tree where n > 1
    ), upper_nodes as (select level, spot, node from upper where n > 1
    ), starts as (
        select doc_id, coalesce('s' || l.source, '') as key, l.spot, s.spot as top_at, s.height, leaf, claim, subroot
        from leaves l join subroots s on l.source is not distinct from s.source
    ), heights as (select max(level) as tall from upper
    ), steps as (
        select doc_id, claim, g as step, key, g as level, spot // cast(pow(3, g) as bigint) as spot, false as above
        from starts, range(0, 40) r(g) where g < height
        union all
        select doc_id, claim, height + g, key, g, top_at // cast(pow(3, g) as bigint), true
        from starts, heights, range(0, 40) r(g) where g < tall
    ), beside as (
        select s.doc_id, s.claim, step,
               coalesce(string_agg(n.node, '' order by n.spot) filter (where n.spot < s.spot), '') as left_side,
               coalesce(string_agg(n.node, '' order by n.spot) filter (where n.spot > s.spot), '') as right_side
        from steps s join (
            select key, level, spot, node, false as above from nodes
            union all select null, level, spot, node, true from upper_nodes
        ) n on s.above = n.above and s.level = n.level and s.spot // 3 = n.spot // 3 and (s.above or s.key = n.key)
        group by s.doc_id, s.claim, step
    ), proofs as (
        select doc_id, claim, string_agg(left_side || right_side, '' order by step) as proof from beside group by doc_id, claim
    ), folded as (
        select doc_id, claim, 0 as step, claim as node from starts
        union all
        select f.doc_id, f.claim, f.step + 1, sha256(left_side || node || right_side)
        from folded f join beside b on f.doc_id = b.doc_id and f.claim = b.claim and f.step = b.step
    ), ends as (
        select doc_id, claim, arg_max(node, step) as folded_root from folded group by doc_id, claim
    )
    select s.doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) as proof_sha256, folded_root, folded_root = root as verified
    from starts s join ends e using (doc_id, claim) left join proofs p using (doc_id, claim), whole
    """,
)
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """The Merkle proof of every document, and what it says of the document as it is held now."""
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    now = F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    docs = read(spark, folder, "documents")
    made = merkle.manifest(docs, names, by="source", order="doc_id", claim=[*map(F.col, names[:-1]), now])
    return made.prove().select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", "verified"
    )


@query(
    "op13_segments",
    """
    with ok as (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
               list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
        from embeddings
        where label is not null and embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
        select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
               cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) as bigint) as score
        from ok a join ok c on a.vec_id <> c.vec_id
        where a.vec_id % 50 = 0
    ), positives as (
        select anchor_id, vec_id as positive_id, score as positive_score from (
            select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from scored where same
        ) where n <= 5
    ), negatives as (
        select p.*, s.vec_id as negative_id, s.score as negative_score, cast(row_number() over (
            partition by anchor_id, positive_id order by s.score desc, s.vec_id) as integer) as rank
        from positives p join scored s using (anchor_id)
        where not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
    )
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 3
    """,
)
def op13_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector and its five best positives."""
    label = F.expr("cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as long)")
    vectors = read(spark, folder, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return segments.hard_negatives(vectors, F.expr("vec_id % 50 = 0"), vector="embedding")
