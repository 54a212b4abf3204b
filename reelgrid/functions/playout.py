"""Playout rules as column expressions: picks, transitions, remaining times, weights and gains."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.functions.timebase import idiv

# Default lengths of a mix and of the crossfade under a cut, the longest transition, slowest clip
# speed, and the samples of a gain edge.
DEFAULT_MIX_FRAMES = 25
DEFAULT_CUT_AUDIO_FRAMES = 2
MAX_TRANSITION_FRAMES = 250
MIN_CLIP_SPEED = 0.01
EDGE_SAMPLES = 240


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def play_time(in_ns, out_ns, speed) -> Column:
    """Time a clip takes to play; a speed of about zero counts as 1."""
    rate = F.when(F.abs(_c(speed)) < 1e-3, 1.0).otherwise(F.abs(_c(speed)))
    return ((_c(out_ns) - _c(in_ns)) / rate).cast("long")


def clip_remaining(position, out_ns, speed) -> Column:
    """Time until OUT, truncated; 0 at or after OUT; null when the clip does not play forward."""
    position, out_ns, speed = _c(position), _c(out_ns), _c(speed)
    left = (out_ns - position).cast("double") / speed
    return F.when(position >= out_ns, F.lit(0).cast("long")).when(speed > 0, left.cast("long"))


def transition_frames(transition, frames, audio_frames) -> Column:
    """Picture and audio lengths of the join into an entry, and the longer of the two."""
    mix = _c(transition) == "mix"
    frames, audio_frames = _c(frames).cast("int"), _c(audio_frames).cast("int")
    asked = F.when(frames > 0, frames).otherwise(DEFAULT_MIX_FRAMES)
    video = F.when(mix, F.least(asked, F.lit(MAX_TRANSITION_FRAMES))).otherwise(0)
    audio = F.when(audio_frames >= 0, audio_frames).when(mix, video).otherwise(DEFAULT_CUT_AUDIO_FRAMES)
    audio = F.least(audio, F.lit(MAX_TRANSITION_FRAMES))
    return F.struct(video.alias("video"), audio.alias("audio"), F.greatest(video, audio).alias("length"))


def mix_weight(k, n) -> Column:
    k, n = _c(k), _c(n)
    inside = (k + 1).cast("double") / (n + 1).cast("double")
    return F.when((n <= 0) | (k >= n), 1.0).when(k < 0, 0.0).otherwise(inside)


def weight_1024(weight) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(1024), F.round(_c(weight) * 1024).cast("int")))


def blend_sample(a, b, weight) -> Column:
    """Ten-bit blend of two samples at a weight of 0…1024."""
    return F.shiftright(_c(a) * (F.lit(1024) - _c(weight)) + _c(b) * _c(weight), 10)


def crossfade_gains(n, total) -> Column:
    """Equal-power gains of sample n of a crossfade, exact outside it."""
    n, total = _c(n), _c(total)
    angle = (n.cast("double") + 0.5) / total.cast("double") * (math.pi / 2)
    done, early = (total <= 0) | (n >= total), n < 0
    return F.struct(
        F.when(done, 0.0).when(early, 1.0).otherwise(F.cos(angle)).alias("out"),
        F.when(done, 1.0).when(early, 0.0).otherwise(F.sin(angle)).alias("in"),
    )


def end_fade(remaining, fade) -> Column:
    remaining, fade = _c(remaining), _c(fade)
    full = remaining.isNull() | (remaining < 0) | (fade <= 0) | (remaining >= fade)
    return F.when(full, 1.0).otherwise(remaining.cast("double") / fade.cast("double"))


def edge_gain(position, length) -> Column:
    """Short linear edges at both ends of a sound."""
    position, length = _c(position), _c(length)
    half = idiv(length.cast("long"), 2)
    edge = F.least(F.lit(EDGE_SAMPLES).cast("long"), F.when(half > 0, half).otherwise(1)).cast("double")
    rise, fall = (position.cast("double") + 0.5) / edge, ((length - position).cast("double") - 0.5) / edge
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rise, fall))
    return F.when((position < 0) | (position >= length), 0.0).otherwise(inside)


def gain_ramp(samples, start, end) -> Column:
    """A block of samples under a gain that goes linearly from ``start`` to ``end``."""
    samples, start, end = _c(samples), _c(start), _c(end)
    last = F.greatest(F.size(samples) - 1, F.lit(1)).cast("double")
    return F.transform(samples, lambda x, i: x * (start + (end - start) * (i.cast("double") / last)))


def tally_effective(lh, rh, text) -> Column:
    """The colour a tally shows: its text's, else the right hand's, else the left hand's."""
    zero = F.lit(0)
    return F.coalesce(F.nullif(_c(text), zero), F.nullif(_c(rh), zero), _c(lh))


def channel_label(live: Column, black: Column, playing: Column, shot: Column) -> Column:
    return (
        F.when(live, "live").when(black, "black").when(playing, "playing")
        .when(shot.isin("cued", "ended"), shot).otherwise("paused")
    )


def progress(position, in_ns, out_ns) -> Column:
    """How far a shot is, from 0 to 1."""
    position, in_ns, out_ns = _c(position), _c(in_ns), _c(out_ns)
    share = (position - in_ns).cast("double") / (out_ns - in_ns).cast("double")
    return F.when(out_ns <= in_ns, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
