"""Picture and sound maths."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import playout as pf
from reelgrid.operators import signal as sg
from reelgrid.plans.asof import nearest
from reelgrid.registry import query

PERIOD = 20_000_000
PAIRS = "pr as (select a.vec_id, a.luma a, b.luma b from pictures a join pictures b on b.vec_id=a.vec_id+1)"


def pairs(t):
    return sg.with_pairs(t.pictures, "vec_id", "luma")


def text(column):
    return F.array_join(F.transform(column, lambda v: v.cast("string")), ",")


@query(
    "plane_blend",
    f"""with {PAIRS}, w as (select *, cast(least(1024, greatest(0, round(1024*((vec_id%11)/10.0)))) as int) w from pr),
    m as (select vec_id, list_transform(list_zip(a, b), lambda p: ((p[1]*(1024-w)+p[2]*w)>>10)) v from w)
    select vec_id, list_aggregate(v[1:32], 'string_agg', ',') y, list_aggregate(v[33:48], 'string_agg', ',') cb, list_aggregate(v[49:64], 'string_agg', ',') cr from m""",
    "pictures",
)
def _(t):
    weight = pf.weight_1024(F.col("vec_id") % 11 / 10)
    planes = {"y": (1, 32), "cb": (33, 16), "cr": (49, 16)}
    return pairs(t).select(
        "vec_id",
        *[text(sg.plane_blend(F.slice("a", at, n), F.slice("b", at, n), weight)).alias(p) for p, (at, n) in planes.items()],
    )


@query(
    "psnr",
    f"""with {PAIRS}, m as (select vec_id, list_sum(list_transform(list_zip(a,b), lambda p: pow((p[1]-p[2])*255.0/1023.0, 2)))/64 mse from pr)
    select vec_id, round(case when mse<=1e-12 then 99 else 10*log10(65025/mse) end,6) psnr from m""",
    "pictures",
)
def _(t):
    return pairs(t).select("vec_id", F.round(sg.psnr("a", "b", 1023.0), 6).alias("psnr"))


TALL = """tall as (select vec_id//4 picture, list_resize(list_reduce(list(luma order by vec_id), lambda a, b: list_concat(a, b)), 256, 0) luma from pictures group by 1)"""


def tall(t):
    """Pictures of 8 × 32: four tiles one below the other, the last picture filled up with black."""
    tiles = F.sort_array(F.collect_list(F.struct("vec_id", "luma")))
    grouped = t.pictures.groupBy(F.expr("vec_id div 4").alias("picture")).agg(tiles.alias("tiles"))
    luma = F.flatten(F.transform("tiles", lambda x: x["luma"]))
    return grouped.select("picture", F.concat(luma, F.array_repeat(F.lit(0), F.lit(256) - F.size(luma))).alias("luma"))


@query(
    "ssim",
    f"""with {TALL}, p as (select a.picture, a.luma a, b.luma b from tall a join tall b on b.picture=a.picture+1),
    x as (select picture, i//64 w, a[i+1]/1023.0 va, b[i+1]/1023.0 vb from p, range(256) r(i)),
    g as (select picture, w, avg(va) ma, avg(vb) mb, var_pop(va) xa, var_pop(vb) xb, covar_pop(va,vb) c from x group by all)
    select picture, round(avg((2*ma*mb+1e-4)*(2*c+9e-4)/((ma*ma+mb*mb+1e-4)*(xa+xb+9e-4))),6) ssim from g group by 1""",
    "pictures",
)
def _(t):
    both = sg.with_pairs(tall(t), "picture", "luma")
    return sg.ssim(both, ["picture"], 8, 32, 1023.0).withColumn("ssim", F.round("ssim", 6))


def levels_sql(width: int) -> str:
    return f"""with x as (select vec_id, i%{width} x, i//{width} y, coalesce(luma[i+1], 0) v from pictures, range({8 * width}) r(i)),
    l1 as (select vec_id, x//2 x, y//2 y, avg(v) v from x where x<8 group by all),
    l2 as (select vec_id, x//2 x, y//2 y, avg(v) v from l1 group by all)
    select vec_id, round(sum(case when lv=1 then v end),6) level1, round(sum(case when lv=2 then v end),6) level2
    from (select 1 lv, vec_id, v from l1 union all select 2, vec_id, v from l2) group by 1"""


# Two levels of 8 x 8 samples, and of the same samples laid out 9 wide and filled up, which leaves a column over.
@query("area_mean", f"select e.*, o.level1 odd1, o.level2 odd2 from ({levels_sql(8)}) e join ({levels_sql(9)}) o using (vec_id)", "pictures")
def _(t):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6)
    wide = F.concat("luma", F.array_repeat(F.lit(0), 8))
    first = t.pictures.withColumn("l1", sg.area_mean(F.col("luma"), 8, 8)).withColumn("o1", sg.area_mean(wide, 9, 8))
    both = first.withColumn("l2", sg.area_mean(F.col("l1"), 4, 4)).withColumn("o2", sg.area_mean(F.col("o1"), 4, 4))
    return both.select("vec_id", total("l1").alias("level1"), total("l2").alias("level2"), total("o1").alias("odd1"), total("o2").alias("odd2"))


@query(
    "point_sample",
    """select vec_id, list_aggregate(list_transform(range(15), lambda i: luma[(i//5*8//3)*8+(i%5)*8//5+1]), 'string_agg', ',') luma from pictures""",
    "pictures",
)
def _(t):
    return t.pictures.select("vec_id", text(sg.point_sample(F.col("luma"), 8, 8, 5, 3)).alias("luma"))


def blocks(t):
    return t.base("embeddings").selectExpr("vec_id", "transform(embedding, e -> cast(e as double)) pcm")


@query(
    "crossfade",
    """with g as (select a.vec_id, a.pos, a.l o, b.l i, (a.vec_id%3)*64+a.pos n, a.vec_id%5=4 stopped from samples a join samples b on b.vec_id=a.vec_id+1 and b.pos=a.pos)
    select vec_id, round(sum((pos+1)*case when stopped then o*(1-pos/63.0)+i when n>=160 then i else o*cos(pi()/2*(n+0.5)/160)+i*sin(pi()/2*(n+0.5)/160) end),6) mixed from g group by 1""",
    "samples",
)
def _(t):
    both = sg.with_pairs(blocks(t), "vec_id", "pcm")
    mixed = sg.crossfade(F.col("a"), F.col("b"), F.col("vec_id") % 3 * 64, F.lit(160), F.col("vec_id") % 5 == 4)
    weighted = F.aggregate(F.transform(mixed, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return both.select("vec_id", F.round(weighted, 6).alias("mixed"))


@query(
    "duck_ramp",
    """with recursive d as (select channel, grain n, kind in ('view','click','error') ducked, row_number() over (partition by channel order by grain) i from commands),
    walk(channel, n, i, db) as (
        select channel, cast(-1 as bigint), cast(0 as bigint), cast(0.0 as double) from d group by 1
        union all select d.channel, d.n, d.i, case when d.ducked then greatest(-12.0, w.db-3.0) else least(0.0, w.db+2.0) end
        from walk w join d on d.channel=w.channel and d.i=w.i+1)
    select channel, n, round(db,6) gain_db from walk where i>0""",
    "commands",
)
def _(t):
    samples = t.commands.selectExpr("channel", "grain n", "kind in ('view', 'click', 'error') ducked")
    ramp = sg.duck_ramp(samples, "channel", -12.0, 4.0, 6.0)
    return ramp.select("channel", "n", F.round("gain_db", 6).alias("gain_db"))


@query(
    "end_fade",
    """with r as (select event_id, case when event_id%6=0 then null else event_id*1000000 end rem from events)
    select event_id, round(case when rem is null or rem>=3000000000 then 1.0 else rem/3e9 end,6) gain from r""",
)
def _(t):
    remaining = F.when(F.col("event_id") % 6 != 0, F.col("event_id") * 1_000_000)
    return t.events.select("event_id", F.round(pf.end_fade(remaining, F.lit(3_000_000_000)), 6).alias("gain"))


@query(
    "edge_gain",
    """with p as (select event_id, event_id%1200-20 pos, event_id%1150 len from events), e as (select *, least(240, case when len//2>0 then len//2 else 1 end) e from p)
    select event_id, round(case when pos<0 or pos>=len then 0.0 else greatest(0.0, least(1.0, (pos+0.5)/e, (len-pos-0.5)/e)) end,6) gain from e""",
)
def _(t):
    gain = pf.edge_gain(F.col("event_id") % 1200 - 20, F.col("event_id") % 1150)
    return t.events.select("event_id", F.round(gain, 6).alias("gain"))


@query(
    "aux_mix",
    """with recursive d as (select channel, grain n, value/100 pcm, kind<>'error' wanted, kind in ('view','click') ducked, grain%2500=0 restart,
        case when grain%4=0 then null else grain*100000 end remaining_ns, row_number() over (partition by channel order by grain) i from commands),
    walk(channel, i, n, pcm, rem, place, nxt, run, db) as (
        select channel, cast(0 as bigint), cast(-1 as bigint), cast(0 as double), cast(0 as bigint), cast(-1 as bigint), cast(0 as bigint), 0, cast(0.0 as double) from d group by 1
        union all select channel, i, n, pcm, remaining_ns,
            case when act then case when at0>=1000 then 0 else at0 end else -1 end,
            case when act then case when at0>=1000 then 1 else at0+1 end else at0 end,
            case when act then case when wanted then least(8, run0+1) else run0-1 end else run0 end,
            case when act then case when ducked then greatest(-12.0, db0-3.0) else least(0.0, db0+2.0) end else db0 end
        from (select *, wanted or run0>0 act from (select d.*, case when restart then 0 else w.nxt end at0, case when restart then 0 else w.run end run0,
            case when restart then 0.0 else w.db end db0 from walk w join d on d.channel=w.channel and d.i=w.i+1))),
    g as (select channel, n, pcm, place, pow(10,-6/20.0)*pow(10,db/20)*(case when rem is null or rem>=200000000 then 1 else rem/2e8 end)
        *(case when place<0 then 0.0 else greatest(0.0, least(1.0, (place+0.5)/240, (1000-place-0.5)/240)) end)*run/8.0 gain from walk where i>0)
    select channel, n, place as position, round(gain,6) gain, round(pcm+coalesce(s.l,0)*gain,6) mixed from g left join samples s on s.sample_ix=place""",
    "commands samples",
)
def _(t):
    samples = t.commands.selectExpr(
        "channel", "grain n", "value / 100 pcm", "kind <> 'error' wanted", "kind in ('view', 'click') ducked", "grain % 2500 = 0 restart",
        "case when grain % 4 <> 0 then grain * 100000 end remaining_ns",
    )
    bed = t.samples.selectExpr("sample_ix position", "l bed")
    mixed = sg.aux_mix(samples, bed, 4, 1000, -6.0, True, -12.0, 4.0, 6.0, 200_000_000)
    return mixed.select("channel", "n", "position", F.round("gain", 6).alias("gain"), F.round("mixed", 6).alias("mixed"))


@query(
    "aux_samples",
    f"""with c as (select id, camera, in_ns, cast(in_ns//33366667 as hugeint) f0, cast(regexp_extract(id,'(\\d+)$',1) as bigint)*977 s from clips),
    u as (select *, (f0*48048000+15000)//30000 u0 from c),
    k as (select u.*, f from u, lateral unnest(range(cast(s*30000//48048000-2 as bigint), cast(s*30000//48048000+3 as bigint))) r(f)),
    h as (select id, camera, in_ns, s, f, s-(((f0+f)*48048000+15000)//30000-u0) off, ((f0+f+1)*48048000+15000)//30000-u0 nx from k),
    p as (select id, camera, s, f frame, cast(off as bigint) "offset", in_ns+f*33366667 at_ns from h where off>=0 and nx>s),
    b as (select p.*, f.tai_ns bt from p asof left join frames f on f.camera=p.camera and p.at_ns>=f.tai_ns),
    n as (select b.*, f.tai_ns nt from b asof left join frames f on f.camera=b.camera and b.at_ns<f.tai_ns)
    select id, s sample, frame, "offset", case when bt is null or nt-at_ns<at_ns-bt then coalesce(nt,bt) else bt end frame_ns from n""",
    "clips frames",
)
def _(t):
    asked = t.clips.selectExpr("id", "camera", "in_ns", "cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) * 977 sample")
    placed = asked.withColumn("p", sg.aux_position(F.col("sample"), F.col("in_ns"), 30000, 1001, 33_366_667)).select(
        "id", "camera", "sample", "p.*", (F.col("in_ns") + F.col("p.frame") * 33_366_667).alias("at_ns")
    )
    found = nearest(placed, t.frames, ["camera"], "at_ns", "tai_ns", name="_shown")
    return found.select("id", "sample", "frame", "offset", F.col("_shown.tai_ns").alias("frame_ns"))


@query(
    "audio_follow",
    """with b as (select vec_id, (vec_id%9+1)/4.0 speed from embeddings),
    o as (select vec_id, speed, i, i*speed src from b, lateral unnest(range(cast(greatest(1, round(64/speed)) as bigint))) r(i)),
    x as (select o.*, least(63, cast(floor(src) as int)) lo from o)
    select x.vec_id, count(*) n_samples, round(sum((i+1)*(a.l+(c.l-a.l)*(src-lo))),6) total from x join samples a on a.vec_id=x.vec_id and a.pos=lo
        join samples c on c.vec_id=x.vec_id and c.pos=least(63, lo+1) group by 1""",
    "samples",
)
def _(t):
    followed = blocks(t).withColumn("out", sg.audio_follow("pcm", (F.col("vec_id") % 9 + 1) / 4))
    total = F.aggregate(F.transform("out", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return followed.select("vec_id", F.size("out").cast("long").alias("n_samples"), F.round(total, 6).alias("total"))
