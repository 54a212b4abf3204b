"""Identifiers, enumerations and small scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

# The names of each enumeration, its default, and the other spellings that are understood.
ENUMS = {
    "motion": (("repeat", "blend", "interpolate"), "interpolate", {}),
    "audio": (("mute", "stretch", "follow"), "mute", {}),
    "end_action": (("freeze", "black", "loop", "next", "return-to-live"), "freeze", {"live": "return-to-live"}),
    "transition": (("cut", "mix"), "cut", {}),
}


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def uuid_v5(name, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based version 5 UUID of a text column."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), _c(name).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def video_receiver(seed, camera, phase) -> Column:
    """Resource name of a camera's video input."""
    return F.concat(_c(seed), F.lit("/in/"), _c(camera), F.lit("/video/"), _c(phase))


def audio_receiver(seed, camera) -> Column:
    return F.concat(_c(seed), F.lit("/in/"), _c(camera), F.lit("/audio"))


# The resources of an installation by the pattern of their name; an asterisk stands for each part given.
RESOURCES = {
    "node": "node", "device": "device", "domain": "domain",
    "video_receiver": "in/*/video/*", "audio_receiver": "in/*/audio",
    "video_source": "out/*/video/source", "video_sender": "out/*/video/sender", "video_flow": "out/*/video/flow/*",
    "audio_source": "out/*/audio/source", "audio_sender": "out/*/audio/sender", "audio_flow": "out/*/audio/flow",
    "data_source": "out/*/data/source", "data_sender": "out/*/data/sender", "data_flow": "out/*/data/flow/*",
}


def resource_name(prefix, seed, kind: str, *parts) -> Column:
    """Name of a resource of an installation: its prefix and seed and the pattern of its kind with the parts put in."""
    fixed = RESOURCES[kind].split("*")
    if len(parts) != len(fixed) - 1:
        raise ValueError(f"{kind} takes {len(fixed) - 1} parts")
    texts = [F.lit(fixed[0])]
    for part, text in zip(parts, fixed[1:]):
        texts += [_c(part).cast("string"), F.lit(text)]
    return F.concat(_c(prefix), F.lit("/"), _c(seed), F.lit("/"), *texts)


def resources(kinds: dict[str, tuple], prefix, seed) -> Column:
    """Names of several resources of a row as an array of (kind, name), to be exploded."""
    return F.array(*[F.struct(F.lit(k).alias("resource"), resource_name(prefix, seed, k, *parts).alias("name")) for k, parts in kinds.items()])


def channel_resource(seed, channel, essence: str, role: str, format_token=None) -> Column:
    """Resource name of a channel's ``source``, ``sender`` or ``flow`` for video, audio or data."""
    parts = [_c(seed), F.lit("/out/"), _c(channel), F.lit(f"/{essence}/{role}")]
    if format_token is not None:
        parts += [F.lit("/"), _c(format_token)]
    return F.concat(*parts)


def normalise(kind: str, text) -> Column:
    """A name of the enumeration, its default where unknown, and whether it was known."""
    names, default, aliases = ENUMS[kind]
    text = _c(text)
    known = {**{n: n for n in names}, **aliases}
    found = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])[text]
    return F.struct(F.coalesce(found, F.lit(default)).alias("value"), found.isNotNull().alias("ok"))


def serial(identifier) -> Column:
    """The number after the last dash of an id, 0 when it has none."""
    return F.coalesce(F.regexp_extract(_c(identifier), "-([0-9]+)$", 1).try_cast("bigint"), F.lit(0).cast("long"))


def flow_key(camera, tai_a, tai_b) -> Column:
    return F.concat_ws(":", _c(camera), _c(tai_a), _c(tai_b))


def db_to_gain(db) -> Column:
    db = _c(db)
    return F.when(db <= -120, 0.0).otherwise(F.pow(F.lit(10.0), db / 20))
