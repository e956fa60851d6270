"""Session life cycle: validation, expiry, status and captures that replace others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passplane.operators.catalog import catalog

#: Minutes from creation to the deadline.
TTL_MINUTES = 30


def deadline(created_at: Column, minutes: int = TTL_MINUTES) -> Column:
    """The deadline; activity does not move it."""
    return created_at + F.make_dt_interval(mins=F.lit(minutes))


def is_expired(expires_at: Column, as_of: Column) -> Column:
    """Strictly after the deadline."""
    return as_of > expires_at


def lazily_expired(status: Column, expires_at: Column, as_of: Column) -> Column:
    """The status as a reader sees it: sessions past their deadline expire, completed ones do not."""
    return F.when(~status.isin("COMPLETED", "EXPIRED") & is_expired(expires_at, as_of), "EXPIRED").otherwise(status)


def request_errors(document_type: Column, lat: Column, lng: Column, user_agent: Column) -> Column:
    """What is wrong with a request to create a session: names of fields in order."""
    no = F.lit(None).cast("string")
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(document_type), F.lit("")) == "", "documentType").otherwise(no),
            F.when(~lat.between(-90, 90), "geolocation.lat").otherwise(no),
            F.when(~lng.between(-180, 180), "geolocation.lng").otherwise(no),
            F.when(F.length(user_agent) > 512, "userAgent").otherwise(no),
        )
    )


def missing_sides(sides: Column, captured: Column) -> Column:
    """Required sides without a capture."""
    return F.array_except(sides, captured)


def status(sides: Column, captured: Column) -> Column:
    """CREATED without a capture, COMPLETED with all, else IN_PROGRESS."""
    return F.when(F.size(captured) == 0, "CREATED").when(F.size(missing_sides(sides, captured)) == 0, "COMPLETED").otherwise("IN_PROGRESS")


def kept_capture(captures: DataFrame, keys: list[str], order: list[str], replace: bool) -> DataFrame:
    """One capture of each side: the last with replacement, the first without. order: unique within keys.

    One struct a key is reduced, so it pre-aggregates; a window would gather a key's captures.
    """
    others = [c for c in captures.columns if c not in [*keys, *order]]
    row = F.struct(*order, *others)
    best = (F.max if replace else F.min)(row).alias("kept")
    return captures.groupBy(*keys).agg(best, F.count("*").alias("attempts")).select(*keys, *[f"kept.{c}" for c in [*order, *others]], "attempts")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both; of each key that with the highest version."""
    return kept_capture(old.unionByName(new), keys, [version], replace=True).drop("attempts")


def allowed_side(sides: Column, side: Column) -> Column:
    """Whether the type has this side."""
    return F.array_contains(sides, side)


def image_path(base: str, session_id: Column, side: Column) -> Column:
    """Where an image is kept."""
    return F.concat(F.concat_ws("/", F.lit(base), session_id, side), F.lit(".jpg"))


def lookup(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are wanted, each once: a session by its id, captures by session, or a capture by session and side."""
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def created(requests: DataFrame, now: Column) -> DataFrame:
    """Sessions of requests (session_id, document_type, lat, lng, user_agent) that are right and of a known type, as they begin."""
    right = requests.where(F.size(request_errors(F.col("document_type"), F.col("lat"), F.col("lng"), F.col("user_agent"))) == 0)
    known = right.join(F.broadcast(catalog(requests.sparkSession).select(F.col("code").alias("document_type"))), "document_type", "left_semi")
    return known.select("session_id", "document_type", F.lit("CREATED").alias("status"), "lat", "lng", "user_agent", now.alias("created_at"), deadline(now).alias("expires_at"))


def uploaded(captures: DataFrame, content: str, base: str) -> DataFrame:
    """Adds image_path and image_sha256, the digest of the image's bytes, to captures (session_id, side, content); empty
    images are left out."""
    rows = captures.where(F.length(content) > 0)
    return rows.select(*[c for c in captures.columns if c != content], image_path(base, F.col("session_id").cast("string"), F.col("side")).alias("image_path"), F.sha2(content, 256).alias("image_sha256"))
