"""Identifiers, stream keys and canonical hashes, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(*parts: Column) -> Column:
    """The text that is hashed: the parts as strings, nulls as empty ones, each on a line."""
    return F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def content_hash(*parts: Column) -> Column:
    return F.sha2(canonical(*parts), 256)


def stable_id(*parts: Column) -> Column:
    """A UUID of version 4's shape from the SHA-256 of the parts."""
    h = content_hash(*parts)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def short_hash(*parts: Column) -> Column:
    """The first 16 hexadecimal digits."""
    return F.substring(content_hash(*parts), 1, 16)


def slice_hash(stream: Column, tick: Column, frame: Column) -> Column:
    """Names the state of a stream at a tick in a frame."""
    return short_hash(F.lit("slice"), stream, tick, frame)


def point_hash(lat: Column, lon: Column, tick: Column) -> Column:
    """Names a place at a tick, in micro-degrees."""
    micro = lambda c: F.round(c * 1e6).cast("long")
    return short_hash(F.lit("point"), micro(lat), micro(lon), tick)


def region_hash(spec: Column) -> Column:
    return F.sha2(F.to_json(spec), 256)


def model_name(model: Column) -> Column:
    """Bare numbers get an M before them."""
    return F.when(model.rlike("^[0-9]+$"), F.concat(F.lit("M"), model)).otherwise(model)


def stream_key(variant: Column, branch: Column, level: Column, domain: Column, model: Column) -> Column:
    return F.concat_ws(":", variant, branch, F.concat(F.lit("L"), level.cast("string")), domain, model_name(model))


def parsed_stream_key(key: Column) -> Column:
    """Struct of the five parts, null where the key has another form."""
    p = F.split(key, ":")
    valid = key.rlike("^[^:]+:[^:]+:L[0-9]+:[^:]+:[^:]+$")
    level = F.regexp_replace(p[2], "^L", "").cast("int")
    return F.when(valid, F.struct(p[0].alias("variant"), p[1].alias("branch"), level.alias("level"), p[3].alias("domain"), p[4].alias("model")))
