"""Keys, paths, URLs and other small string forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanefold.functions.text import once

RUN_ID = r"\A[0-9a-f]{7}-[a-z0-9_-]+-([0-9]{8}T[0-9]{6}Z|DRYRUN)\z"


def compose_pk(video_id: Column, frame_id: Column) -> Column:
    """Global key of a frame; NULL as soon as one part is NULL."""
    return F.concat(video_id, F.lit("_"), frame_id)


def frame_id_of_path(path: Column) -> Column:
    """Parent folder name and file stem."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    parent = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.concat(parent, F.lit("_"), stem)


def collection_of(path: Column) -> Column:
    """First collection token (an L and one to three digits) of a path, or ``?``."""
    token = F.upper(F.regexp_extract(path, r"(?i)(L\d{1,3})", 1))
    return F.when(token == "", F.lit("?")).otherwise(token)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def human_bytes(n: Column) -> Column:
    """Bytes in steps of 1024 with one decimal."""
    size = n.cast("double")
    out = F.format_string("%.1fTB", size / F.lit(1024.0**4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        scaled = size / F.lit(1024.0**power)
        out = F.when(scaled < 1024, F.format_string(f"%.1f{unit}", scaled)).otherwise(out)
    return out


def compact_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def run_id(git_sha: Column, job: Column, started: Column) -> Column:
    return F.concat_ws("-", F.substring(git_sha, 1, 7), job, compact_utc(started))


def is_run_id(x: Column) -> Column:
    return x.rlike(RUN_ID)


def endpoint_of(url: Column) -> Column:
    """Scheme and host (with port) of a URL that has a path; other URLs stay as they are."""
    host = F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)/+[^/?#]", 1)
    return F.when(host == "", url).otherwise(host)


def key_values(pairs: Column) -> Column:
    """Map of ``key=value`` strings: split on the first ``=``, the last value of a key wins.

    An item without ``=`` is an error.
    """
    entries = F.transform(
        pairs,
        lambda p: F.when(
            F.contains(p, F.lit("=")),
            F.struct(
                F.substring_index(p, "=", 1).alias("key"),
                F.regexp_replace(p, r"\A[^=]*=", "").alias("value"),
            ),
        ).otherwise(F.raise_error(F.concat(F.lit("expected key=value, got "), p))),
    )
    def last_wins(found: Column) -> Column:
        keys = F.transform(found, lambda e: e["key"])
        kept = F.filter(
            found, lambda e, i: i == F.size(found) - F.array_position(F.reverse(keys), e["key"])
        )
        return F.map_from_entries(kept)

    return once(entries, last_wins)


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def thumb_url(video_id: Column, frame_id: Column) -> Column:
    return F.format_string("/thumbs/%s/%s.jpg", video_id, frame_id)


def full_url(video_id: Column, frame_id: Column) -> Column:
    return F.format_string("/frames/%s/%s.jpg", video_id, frame_id)
