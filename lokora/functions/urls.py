"""Column expressions over search hits, raw-file URLs and repository paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values ----------------------------------------------------------
GITHUB_HOST = "github.com"
GITLAB_HOST = "gitlab.com"
GITHUB_RAW = "https://raw.githubusercontent.com/"
GITLAB_RAW = "https://gitlab.com/"
PO_SUFFIX = r"\.po$"
# ---------------------------------------------------------------------------


def hit_to_raw_url(repository: Column, commit: Column, path: Column) -> Column:
    """Raw-file URL of a hit; null for a null repository or an unknown host."""
    host = F.substring_index(repository, "/", 1)
    project = F.regexp_extract(repository, r"\A[^/]*/(.*)\z", 1)
    return F.when(
        host == GITHUB_HOST, F.concat(F.lit(GITHUB_RAW), project, F.lit("/"), commit, F.lit("/"), path)
    ).when(
        host == GITLAB_HOST,
        F.concat(F.lit(GITLAB_RAW), project, F.lit("/-/raw/"), commit, F.lit("/"), path),
    )


def is_po_url(url: Column) -> Column:
    return url.rlike(PO_SUFFIX)


def matches_locale(path: Column, lang: str) -> Column:
    """``…/de.po`` or ``…/de?de.po`` (any one character between), any case."""
    lg = re.escape(lang)
    return path.rlike(rf"(?i)/{lg}(.{lg})?\.po$")


def url_to_path(url: Column) -> Column:
    """Repository-relative path of a raw URL; null for other hosts."""
    return F.when(url.contains(GITHUB_RAW), F.replace(url, F.lit(GITHUB_RAW), F.lit(""))).when(
        url.contains(GITLAB_RAW), F.replace(url, F.lit(GITLAB_RAW), F.lit(""))
    )


def with_provenance(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host, owner, repo, commit and path columns parsed from a raw URL.

    Both layouts are accepted on both hosts: some published URLs carry the
    ``/-/raw`` part on the host that does not use it.  A project may be nested
    in groups where that part is present.
    """
    col = F.col(url)
    marked = r"\Ahttps://([^/]+)/([^/]+)/(.+?)/-/raw/([^/]+)/(.+)\z"
    plain = r"\Ahttps://([^/]+)/([^/]+)/([^/]+)/([^/]+)/(.+)\z"
    has_mark = col.contains("/-/raw/")

    def part(n: int) -> Column:
        value = F.when(has_mark, F.regexp_extract(col, marked, n)).otherwise(
            F.regexp_extract(col, plain, n)
        )
        return F.nullif(value, F.lit(""))

    host = F.nullif(F.regexp_extract(col, r"\Ahttps://([^/]+)/", 1), F.lit(""))
    known = host.isin(GITHUB_RAW[8:-1], GITLAB_RAW[8:-1])
    names = ["owner", "repo", "commit", "path"]
    return df.withColumns(
        {"host": F.when(known, host)}
        | {name: F.when(known, part(i + 2)) for i, name in enumerate(names)}
    )
