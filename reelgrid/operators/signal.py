"""Pictures and sound as arrays and samples: blends, quality measures, sampling, gains and mixes."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from reelgrid.functions.identity import db_to_gain
from reelgrid.functions.playout import blend_sample, crossfade_gains, edge_gain, end_fade
from reelgrid.functions.timebase import idiv, samples_until, stretch_length
from reelgrid.plans.fold import Machine, Rows, fold_timeline
from reelgrid.plans.lines import Line, towards
from reelgrid.plans.ordered import last_value, previous_row, running, running_count, spread

# The window and the two constants of the structural similarity, and a peak for equal pictures.
SSIM_WINDOW = 8
SSIM_C1 = 0.01 * 0.01
SSIM_C2 = 0.03 * 0.03
PSNR_EQUAL = 99.0


def plane_blend(a, b, weight) -> Column:
    """Blend two planes sample by sample at a weight of 0…1024; the shorter one sets the length."""
    size = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, size), F.slice(b, 1, size), lambda x, y: blend_sample(x, y, weight))


def psnr(a, b, scale: float) -> Column:
    """Peak signal-to-noise ratio in dB of two planes of samples 0…``scale``, measured in 8 bits."""
    errors = F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (255.0 / scale))
    mse = F.aggregate(errors, F.lit(0.0), lambda s, d: s + d * d) / F.size(a)
    comparable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    value = F.when(mse <= 1e-12, PSNR_EQUAL).otherwise(F.log10(F.lit(255.0 * 255.0) / mse) * 10.0)
    return F.when(comparable, value).otherwise(0.0)


def ssim(pairs: DataFrame, keys: list[str], width: int, height: int, scale: float) -> DataFrame:
    """Mean structural similarity of planes ``a`` and ``b`` over whole 8×8 windows; 0 for a picture without one."""
    pixel = pairs.select(*keys, F.posexplode_outer(F.arrays_zip("a", "b")).alias("_i", "_p"))
    wx, wy = F.expr(f"(_i % {width}) div {SSIM_WINDOW}"), F.expr(f"_i div {width} div {SSIM_WINDOW}")
    x, y = F.col("_p.a") / scale, F.col("_p.b") / scale
    windows = pixel.groupBy(*keys, wx.alias("_wx"), wy.alias("_wy")).agg(
        F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.var_pop(x).alias("va"), F.var_pop(y).alias("vb"), F.covar_pop(x, y).alias("cov")
    )
    ma, mb = F.col("ma"), F.col("mb")
    top = (ma * mb * 2 + SSIM_C1) * (F.col("cov") * 2 + SSIM_C2)
    bottom = (ma * ma + mb * mb + SSIM_C1) * (F.col("va") + F.col("vb") + SSIM_C2)
    inside = (F.col("_wx") < width // SSIM_WINDOW) & (F.col("_wy") < height // SSIM_WINDOW)
    return windows.groupBy(*keys).agg(F.coalesce(F.avg(F.when(inside, top / bottom)), F.lit(0.0)).alias("ssim"))


def area_mean(plane, width: int, height: int) -> Column:
    """The next pyramid level: means of 2×2 samples, of those inside the picture at an odd edge."""
    out_w, out_h = max(1, width >> 1), max(1, height >> 1)

    def mean(i: Column) -> Column:
        x, y = i % out_w * 2, idiv(i, out_w) * 2
        at = lambda dx, dy: F.when(
            (x + dx < width) & (y + dy < height), F.get(plane, ((y + dy) * width + x + dx).cast("int"))
        ).cast("double")
        cells = [at(dx, dy) for dy in (0, 1) for dx in (0, 1)]
        total = sum((F.coalesce(c, F.lit(0.0)) for c in cells[1:]), F.coalesce(cells[0], F.lit(0.0)))
        return total / sum((c.isNotNull().cast("int") for c in cells[1:]), cells[0].isNotNull().cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(out_w * out_h - 1)), mean)


def point_sample(plane, width: int, height: int, out_width: int, out_height: int) -> Column:
    """A smaller raster from the nearest lower samples."""

    def sample(i: Column) -> Column:
        x, y = idiv(i % out_width * width, out_width), idiv(idiv(i, out_width) * height, out_height)
        return F.get(plane, (y * width + x).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(out_width * out_height - 1)), sample)


def crossfade(outgoing, incoming, first, total, stopped: Column) -> Column:
    """Sum of two blocks under equal-power gains from sample ``first`` on.

    When the channel stops, the outgoing block fades out linearly over this block instead.
    """
    size = F.greatest(F.size(outgoing) - 1, F.lit(1)).cast("double")

    def mixed(pair: Column, i: Column) -> Column:
        gains = crossfade_gains(first + i, total)
        out = F.when(stopped, 1.0 - i.cast("double") / size).otherwise(gains["out"])
        return pair["o"] * out + pair["i"] * F.when(stopped, 1.0).otherwise(gains["in"])

    pairs = F.zip_with(outgoing, incoming, lambda o, i: F.struct(o.alias("o"), i.alias("i")))
    return F.transform(pairs, mixed)


def audio_follow(samples, speed) -> Column:
    """Resample a block by its speed with linear interpolation; the last sample is held."""
    size = F.size(samples)

    def sample(i: Column) -> Column:
        source = i.cast("double") * speed
        low = F.least(size - 1, F.floor(source).cast("int"))
        a, b = F.get(samples, low), F.get(samples, F.least(size - 1, low + 1))
        return a + (b - a) * (source - low)

    length = stretch_length(size, speed).cast("int")
    return F.when(size == 0, F.col(samples) if isinstance(samples, str) else samples).otherwise(F.transform(F.sequence(F.lit(0), length - 1), sample))


def duck_ramp(samples: DataFrame, key: str, depth_db: float, attack: float, release: float) -> DataFrame:
    """Gain in dB of each sample: to the depth while ``ducked``, back to 0 after, at constant dB per sample.

    Inside a run of equal ``ducked`` the gain is a clamped line; only where each run starts from is folded.
    """
    depth = min(0.0, depth_db)
    down, up = (-depth / attack if attack >= 1 else -depth), (-depth / release if release >= 1 else -depth)
    cut = spread(samples, [key], ["n"])
    seen = running(cut, [key], ["n"], _i=running_count(), _was=previous_row("ducked"))
    new = F.coalesce(F.col("_was.ducked") != F.col("ducked"), F.lit(True))
    starts = seen.filter(new).select(key, "_i", "ducked")

    def line(ducked: bool, k: int) -> Line:
        return Line(1, -down * k, low=depth) if ducked else Line(1, up * k, high=0.0)

    def step(state: str | None, rows: Rows) -> tuple[Rows, str]:
        db, ducked, since = json.loads(state) if state else (0.0, False, 1)
        found = []
        for at, flag in zip(rows["_i"], rows["ducked"], strict=True):
            db = line(ducked, at - since)(db)
            ducked, since = flag, at
            found.append(db)
        return {"_db": found}, json.dumps([db, ducked, since])

    def extend(effect: tuple | None, rows: Rows) -> tuple:
        for at, flag in zip(rows["_i"], rows["ducked"], strict=True):
            if effect is None:
                effect = at, Line(), flag, at
            else:
                first, gain, ducked, since = effect
                effect = first, gain.then(line(ducked, at - since)), flag, at
        return effect

    def enter(effect: tuple, state: str) -> str:
        first, gain, flag, at = effect
        db, ducked, since = json.loads(state)
        return json.dumps([gain(line(ducked, first - since)(db)), flag, at])

    begun = fold_timeline(starts, [key], ["_i"], Machine(step, extend, enter), [StructField("_db", DoubleType())])
    # a run's start meets its own sample and is carried on from there, so a long run is no join key
    met = seen.join(begun, [key, "_i"], "left").withColumn("_run", F.when(F.col("_db").isNotNull(), F.struct(F.col("_i").alias("_start"), "_db")))
    runs = running(met.drop("_db"), [key], ["n"], _last=last_value("_run")).select("*", "_last._start", "_last._db")
    k = F.col("_i") - F.col("_start") + 1
    db = F.when(F.col("ducked"), F.greatest(F.lit(depth), F.col("_db") - k * down)).otherwise(
        F.least(F.lit(0.0), F.col("_db") + k * up)
    )
    return runs.select(*samples.columns, db.alias("gain_db"))


def aux_position(position: Column, in_ns: Column, num: int, den: int, period_ns: int) -> Column:
    """Frame of a clip, counted from IN, that carries sample ``position`` of its sound, and the offset in it."""
    first = idiv(in_ns, period_ns)
    until = lambda f: samples_until(first + f, num, den) - samples_until(first, num, den)
    guess = idiv(position * num, 48000 * den)
    frame = F.when(until(guess) > position, guess - 1).when(until(guess + 1) <= position, guess + 1).otherwise(guess)
    return F.struct(frame.alias("frame"), (position - until(frame)).alias("offset"))


def clip_samples(in_ns: Column, out_ns: Column, num: int, den: int, period_ns: int) -> Column:
    """Samples of sound a clip has."""
    first, frames = idiv(in_ns, period_ns), idiv(out_ns - in_ns, period_ns) + 1
    return samples_until(first + frames, num, den) - samples_until(first, num, den)


def bed_machine(full: int, depth: float, down: float, up: float) -> Machine:
    """Fade steps, ducking and sounded samples of a bed where each run of equal flags starts.

    What runs do depends on the fade steps before them, of which there are few, and for each on the ducking by a clamped
    line; an effect is a table of these lines, as long as the fade.
    """
    fresh = (0, 0.0, 0)

    def through(wanted: bool, ducked: bool, k: int, fade: int, db: float, sounded: int) -> tuple[int, float, int]:
        """Fade, ducking and sounded samples after ``k`` samples of a run."""
        steps = k if wanted else min(k, fade)
        return (min(full, fade + k) if wanted else max(0, fade - k)), towards(db, depth if ducked else 0.0, steps, down, up), sounded + steps

    def step(state: str | None, rows: Rows) -> tuple[Rows, str]:
        wanted, ducked, since, *now = json.loads(state) if state else (False, False, 1, *fresh)
        out: Rows = {"_fade": [], "_db": [], "_sounded": []}
        for at, *flags, restart in zip(rows["_i"], rows["wanted"], rows["ducked"], rows["restart"], strict=True):
            now = fresh if restart else through(wanted, ducked, at - since, *now)
            (wanted, ducked), since = flags, at
            for values, value in zip(out.values(), now):
                values.append(value)
        return out, json.dumps([wanted, ducked, since, *now])

    def extend(effect: dict | None, rows: Rows) -> dict:
        for at, *flags, restart in zip(rows["_i"], rows["wanted"], rows["ducked"], rows["restart"], strict=True):
            if effect is None:
                # fade, low, high and shift of the ducking's line, sounded samples, for every fade before the first run
                table = [np.arange(full + 1), np.full(full + 1, -np.inf), np.full(full + 1, np.inf), np.zeros(full + 1), np.zeros(full + 1, np.int64)]
                effect = {"first": at, "flags": flags, "since": at, "table": table, "fixed": fresh if restart else None}
                continue
            wanted, ducked = effect["flags"]
            k = at - effect["since"]
            if restart:
                effect["fixed"] = fresh
            elif effect["fixed"]:
                effect["fixed"] = through(wanted, ducked, k, *effect["fixed"])
            else:
                fade, low, high, shift, sounded = effect["table"]
                steps = np.full(full + 1, k) if wanted else np.minimum(k, fade)
                move = -down * steps if ducked else up * steps
                # the ducking stays between its depth and 0, so it only ever moves towards one of them
                low, high = (np.clip(edge + move, depth if ducked else -np.inf, np.inf if ducked else 0.0) for edge in (low, high))
                effect["table"] = [np.minimum(full, fade + k) if wanted else np.maximum(0, fade - k), low, high, shift + move, sounded + steps]
            effect |= {"flags": flags, "since": at}
        return effect

    def enter(effect: dict, state: str) -> str:
        wanted, ducked, since, *now = json.loads(state)
        found = effect["fixed"]
        if found is None:
            fade, db, sounded = through(wanted, ducked, effect["first"] - since, *now)
            to, low, high, shift, more = (column[fade].item() for column in effect["table"])
            found = to, max(low, min(high, db + shift)), sounded + more
        return json.dumps([*effect["flags"], effect["since"], *found])

    return Machine(step, extend, enter)


def aux_mix(
    samples: DataFrame,
    source: DataFrame,
    grain: int,
    length: int,
    level_db: float,
    loop: bool,
    duck_db: float,
    attack: float,
    release: float,
    fade_ns: int,
) -> DataFrame:
    """Mix a bed under each channel's samples.

    ``samples``: channel, n, pcm, wanted, ducked, restart, remaining_ns (null when the list does not end). Within a run
    of equal ``wanted`` and ``ducked`` the bed's fade (in and out over two grains), its ducking and the samples it has
    sounded are clamped lines; only where each run starts from is folded. The bed's sample is found by its position in
    ``source`` (position, bed).
    """
    depth, full = min(0.0, duck_db), 2 * grain
    down, up = (-depth / rate if rate >= 1 else -depth for rate in (attack, release))
    keys, order = ["channel"], ["n"]
    cut = spread(samples.select("channel", "n", "wanted", "ducked", "restart"), keys, order)
    seen = running(cut, keys, order, _i=running_count(), _was=previous_row("wanted", "ducked"))
    same = (F.col("_was.wanted") == F.col("wanted")) & (F.col("_was.ducked") == F.col("ducked")) & ~F.col("restart")
    starts = seen.filter(~F.coalesce(same, F.lit(False))).select("channel", "_i", "wanted", "ducked", "restart")
    fields = [StructField("_fade", LongType()), StructField("_db", DoubleType()), StructField("_sounded", LongType())]
    begun = fold_timeline(starts, keys, ["_i"], bed_machine(full, depth, down, up), fields)
    start = F.struct(F.col("_i").alias("_start"), "_fade", "_db", "_sounded")
    met = seen.join(begun, ["channel", "_i"], "left").withColumn("_run", F.when(F.col("_fade").isNotNull(), start)).drop("_fade", "_db", "_sounded")
    runs = running(met, keys, order, _last=last_value("_run")).select("channel", "n", "wanted", "ducked", "_i", "_last.*")
    k = F.col("_i") - F.col("_start") + 1
    sounding = F.when(F.col("wanted"), k).otherwise(F.least(k, F.col("_fade")))
    before = F.col("_sounded") + F.when(F.col("wanted"), k - 1).otherwise(F.least(k - 1, F.col("_fade")))
    on = F.col("wanted") | (k <= F.col("_fade"))
    fade = F.when(F.col("wanted"), F.least(F.lit(full), F.col("_fade") + k)).otherwise(F.greatest(F.lit(0), F.col("_fade") - k))
    goal = F.when(F.col("ducked"), F.lit(depth)).otherwise(0.0)
    db = F.when(F.col("_db") > goal, F.greatest(goal, F.col("_db") - sounding * down)).otherwise(F.least(goal, F.col("_db") + sounding * up))
    inside = before % length if loop and length > 0 else F.when(before < length, before)
    position = F.when(on, F.coalesce(inside, F.lit(-1).cast("long"))).otherwise(-1)
    placed = runs.select("channel", "n", position.alias("position"), (fade * (1.0 / full)).alias("_run"), db.alias("_db"))
    joined = samples.join(placed, ["channel", "n"]).join(source.select("position", "bed"), "position", "left")
    edge = F.when(F.col("position") < 0, 0.0).otherwise(edge_gain("position", F.lit(length).cast("long")))
    gain = (
        db_to_gain(F.lit(level_db)) * db_to_gain("_db") * end_fade("remaining_ns", F.lit(fade_ns)) * edge * F.col("_run")
    )
    return joined.withColumn("gain", gain).withColumn(
        "mixed", F.col("pcm") + F.coalesce(F.col("bed"), F.lit(0.0)) * F.col("gain")
    ).drop("_run", "_db")


def with_pairs(pictures: DataFrame, key: str, plane: str) -> DataFrame:
    """Each picture with the one after it by number, as planes ``a`` and ``b``."""
    after = pictures.select((F.col(key) - 1).alias(key), F.col(plane).alias("b"))
    return pictures.select(key, F.col(plane).alias("a")).join(after, key)
