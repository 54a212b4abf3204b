"""Recording, catalogue and playout tables derived from the supplied star schema, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.plans.ordered import over_timeline, running_count

MICROS = "unix_micros(cast(ts as timestamp))"

VIEWS = {
    "frames": """select cast(user_id%4+1 as int) camera, epoch_us(ts)*1000 tai_ns,
        event_id + case when event_id%7=0 then 9 else 0 end arrival, event_id,
        cast(floor(value) as bigint)%50 payload_id, 1000+event_id%977 payload_bytes,
        event_type<>'error' valid, event_type in ('view','click','purchase') audio_ok from events""",
    "clips": """select 'clip-'||event_id id, 'shot '||event_id as name, cast(user_id%4+1 as int) camera,
        epoch_us(ts)*1000 in_ns, epoch_us(ts)*1000+(60+event_id%1800)*1000000000 out_ns,
        cast(case event_id%4 when 0 then 0.25 when 1 then 0.5 when 2 then 1.0 else 2.0 end as double) speed,
        case event_id%5 when 0 then 'freeze' when 1 then 'black' when 2 then 'loop' when 3 then 'next'
            else 'return-to-live' end end_action,
        event_id%11=0 library, 'k'||json_extract_string(props,'$.k')||', cam'||(user_id%4+1) tags
        from events where event_type='signup' and event_id%17<>0""",
    "all_ids": """select 'clip-'||event_id id, row_number() over (order by event_id)-1 rn, count(*) over () n
        from events where event_type='signup'""",
    "entries": """select 'playlist-'||c.conv_id playlist, c.turn as position, a.id clip_id,
        cast(case c.turn%3 when 0 then 1.0 when 1 then 0.5 else 2.0 end as double) speed,
        case when (c.conv_id+c.turn)%13=12 then 'loop' when (c.conv_id+c.turn)%7=6 then 'freeze' else 'next' end end_action,
        c.turn%4<>3 auto_advance, case when c.turn%3=2 then 'mix' else 'cut' end transition,
        case when c.turn%3=2 then 12 else 0 end transition_frames,
        case c.turn%4 when 1 then 0 when 2 then 10 else -1 end audio_frames, c.turn%5<>4 own_audio
        from conversations c join all_ids a on a.rn=(c.conv_id*37+c.turn*11)%a.n""",
    "grains": """select cast(user_id%2+1 as int) camera, event_id//6 house_index, cast(event_id%3 as int) phase,
        event_id//6*20000000 tai_ns, event_type<>'error' present, event_id payload_id from events""",
    "tally": """select epoch_us(ts)*1000 tai_ns, event_id, cast(event_id%2 as int) screen, cast(user_id%3 as int) display,
        case when event_type='error' then 1 else 0 end lh, case when event_type='view' then 2 else 0 end rh,
        case when event_type='purchase' then 1 else 0 end txt from events""",
    "metrics": """select epoch_us(ts) ts_us, 'playout_seconds' as name, cast(user_id%3+1 as int) channel,
        case when event_id%2=0 then 'render' else 'publish' end stage, value/10000 secs, event_id from events""",
    "pictures": """select vec_id, list_transform(embedding,
        lambda e: cast(round((cast(e as double)+1)*511.5) as int)) luma from embeddings""",
    "probes": """select event_id probe, cast(event_id%4+1 as int) camera, cast(user_id%3+1 as int) channel,
        (epoch_us(ts)*1000+(event_id%1201-600)*1000000000)//20000000*20000000 at_ns from events""",
    "commands": """select cast(user_id%3+1 as int) channel, event_id grain, epoch_us(ts)*1000 tai_ns, event_type kind,
        value, user_id from events""",
    "samples": """select vec_id, cast(pos-1 as int) pos, vec_id*64+pos-1 sample_ix, cast(embedding[pos] as double) l
        from (select vec_id, embedding, unnest(generate_series(1,64)) pos from embeddings)""",
    "ticks": """select channel, grain, kind, case when kind='click'
        then round(value%300)/100-1.0 end target from commands""",
}

# Entries with the clip they name and their list's loop flag.
VIEWS["listed"] = """select e.*, cast(split_part(e.playlist,'-',2) as bigint)%3=0 loop, c.in_ns, c.out_ns, c.id is not null present
    from entries e left join clips c on c.id=e.clip_id"""
NEEDS = {"entries": ["all_ids"], "ticks": ["commands"], "listed": ["entries", "clips"]}


def with_views(names: str, sql: str) -> str:
    """Put the named views in front of a query as common table expressions."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        need(name)
    if not wanted:
        return sql
    head = ",\n".join(f"{name} as ({VIEWS[name]})" for name in wanted)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


class Tables:
    """The supplied folder, opened lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.base("events")

    @cached_property
    def frames(self) -> DataFrame:
        return self.events.selectExpr(
            "cast(user_id % 4 + 1 as int) camera",
            f"{MICROS} * 1000 tai_ns",
            "event_id + case when event_id % 7 = 0 then 9 else 0 end arrival",
            "event_id",
            "cast(floor(value) as bigint) % 50 payload_id",
            "1000 + event_id % 977 payload_bytes",
            "event_type <> 'error' valid",
            "event_type in ('view', 'click', 'purchase') audio_ok",
        )

    @cached_property
    def clips(self) -> DataFrame:
        return self.events.filter("event_type = 'signup' and event_id % 17 <> 0").selectExpr(
            "concat('clip-', event_id) id",
            "concat('shot ', event_id) name",
            "cast(user_id % 4 + 1 as int) camera",
            f"{MICROS} * 1000 in_ns",
            f"{MICROS} * 1000 + (60 + event_id % 1800) * 1000000000 out_ns",
            "case event_id % 4 when 0 then 0.25D when 1 then 0.5D when 2 then 1.0D else 2.0D end speed",
            "case event_id % 5 when 0 then 'freeze' when 1 then 'black' when 2 then 'loop' when 3 then 'next' "
            "else 'return-to-live' end end_action",
            "event_id % 11 = 0 library",
            "concat('k', get_json_object(props, '$.k'), ', cam', user_id % 4 + 1) tags",
        )

    @cached_property
    def ranges(self) -> DataFrame:
        """The clips as protected ranges."""
        return self.clips.selectExpr("camera", "in_ns begin_ns", "out_ns end_ns", "id owner")

    @cached_property
    def all_ids(self) -> DataFrame:
        signups = self.events.filter("event_type = 'signup'").select("event_id", F.lit(0).alias("one"))
        total = signups.agg(F.count("*")).scalar()
        numbered = over_timeline(signups, ["one"], ["event_id"], rn=running_count(before=True))
        return numbered.select(F.concat(F.lit("clip-"), "event_id").alias("id"), "rn", total.alias("n"))

    @cached_property
    def entries(self) -> DataFrame:
        turns = self.base("conversations").select("conv_id", "turn")
        total = self.events.filter("event_type = 'signup'").agg(F.count("*")).scalar()
        picked = turns.withColumn("rn", (F.col("conv_id") * 37 + F.col("turn") * 11) % total)
        return picked.join(self.all_ids, "rn").selectExpr(
            "concat('playlist-', conv_id) playlist",
            "turn position",
            "id clip_id",
            "case turn % 3 when 0 then 1.0D when 1 then 0.5D else 2.0D end speed",
            "case when (conv_id + turn) % 13 = 12 then 'loop' when (conv_id + turn) % 7 = 6 then 'freeze' "
            "else 'next' end end_action",
            "turn % 4 <> 3 auto_advance",
            "case when turn % 3 = 2 then 'mix' else 'cut' end transition",
            "case when turn % 3 = 2 then 12 else 0 end transition_frames",
            "case turn % 4 when 1 then 0 when 2 then 10 else -1 end audio_frames",
            "turn % 5 <> 4 own_audio",
        )

    @cached_property
    def grains(self) -> DataFrame:
        return self.events.selectExpr(
            "cast(user_id % 2 + 1 as int) camera",
            "event_id div 6 house_index",
            "cast(event_id % 3 as int) phase",
            "event_id div 6 * 20000000 tai_ns",
            "event_type <> 'error' present",
            "event_id payload_id",
        )

    @cached_property
    def tally(self) -> DataFrame:
        return self.events.selectExpr(
            f"{MICROS} * 1000 tai_ns",
            "event_id",
            "cast(event_id % 2 as int) screen",
            "cast(user_id % 3 as int) display",
            "case when event_type = 'error' then 1 else 0 end lh",
            "case when event_type = 'view' then 2 else 0 end rh",
            "case when event_type = 'purchase' then 1 else 0 end txt",
        )

    @cached_property
    def metrics(self) -> DataFrame:
        return self.events.selectExpr(
            f"{MICROS} ts_us",
            "'playout_seconds' name",
            "cast(user_id % 3 + 1 as int) channel",
            "case when event_id % 2 = 0 then 'render' else 'publish' end stage",
            "value / 10000 secs",
            "event_id",
        )

    @cached_property
    def pictures(self) -> DataFrame:
        return self.base("embeddings").selectExpr(
            "vec_id", "transform(embedding, e -> cast(round((cast(e as double) + 1) * 511.5D) as int)) luma"
        )

    @cached_property
    def probes(self) -> DataFrame:
        """Output positions that ask for a frame: one per event, on the 20 ms grid, up to ten minutes off it."""
        return self.events.selectExpr(
            "event_id probe",
            "cast(event_id % 4 + 1 as int) camera",
            "cast(user_id % 3 + 1 as int) channel",
            f"({MICROS} * 1000 + (event_id % 1201 - 600) * 1000000000) div 20000000 * 20000000 at_ns",
        )

    @cached_property
    def commands(self) -> DataFrame:
        return self.events.selectExpr(
            "cast(user_id % 3 + 1 as int) channel",
            "event_id grain",
            f"{MICROS} * 1000 tai_ns",
            "event_type kind",
            "value",
            "user_id",
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.base("embeddings").selectExpr("vec_id", "posexplode(embedding) as (pos, e)").selectExpr(
            "vec_id", "pos", "vec_id * 64 + pos sample_ix", "cast(e as double) l"
        )

    @cached_property
    def ticks(self) -> DataFrame:
        """Output grains per channel; a click on a grain asks for a new speed."""
        return self.commands.selectExpr(
            "channel", "grain", "kind", "case when kind = 'click' then round(value % 300) / 100 - 1.0D end target"
        )

    @cached_property
    def listed(self) -> DataFrame:
        """Entries with the clip they name and their list's loop flag."""
        clips = self.clips.select(F.col("id").alias("clip_id"), "in_ns", "out_ns", F.lit(True).alias("present"))
        return (
            self.entries.join(clips, "clip_id", "left")
            .fillna({"present": False})
            .withColumn("loop", F.expr("cast(split(playlist, '-')[1] as bigint) % 3 = 0"))
        )
