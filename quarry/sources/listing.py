"""Repository listings from a paged service: single repositories, organisations, users."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from threading import BoundedSemaphore

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_ROWS, WORKERS, MAX_REQUESTS = 100, 8, 4
SCHEMA = "full_name string, fork boolean, archived boolean, html_url string, clone_url string, ssh_url string"
#: A request: kind (repo, org, user), name, page from 1; its rows and the number of the last page.
Get = Callable[[str, str, int], tuple[list[dict], int]]


def list_object(get: Get, kind: str, name: str, room: BoundedSemaphore, pool: ThreadPoolExecutor) -> list[dict]:
    """All rows of one object in page order: the first page tells how many there are, the others are asked for together."""

    def page(no: int) -> tuple[list[dict], int]:
        with room:
            return get(kind, name, no)

    rows, last = page(1)
    if kind == "repo":
        return rows[:1]
    for more, _ in pool.map(page, range(2, last + 1)):
        rows = rows + more
    return rows


def fetch_listing(get: Get, repos: Iterable[str] = (), orgs: Iterable[str] = (), users: Iterable[str] = (), max_requests: int = MAX_REQUESTS) -> list[dict]:
    """Rows of all objects, in the order given; the first error ends it."""
    jobs = [*(("repo", x) for x in repos), *(("org", x) for x in orgs), *(("user", x) for x in users)]
    room = BoundedSemaphore(max_requests)
    with ThreadPoolExecutor(WORKERS) as objects, ThreadPoolExecutor(max_requests) as pages:
        futures = [objects.submit(list_object, get, kind, name, room, pages) for kind, name in jobs]
        try:
            return [row for f in futures for row in f.result()]
        except Exception:
            for f in futures:
                f.cancel()
            raise


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of pages saved as ``<kind>/<name>/<page>.json``, an array each.

    In order of kind, name, page and place; with a page missing between others, or
    one that is no array of objects, it fails.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    part = lambda i: F.regexp_extract(F.col("file"), r"([^/]+)/([^/]+)/([0-9]+)\.json$", i)
    pages = raw.select("value", F.col("_metadata.file_path").alias("file")).select("value", part(1).alias("kind"), part(2).alias("name"), part(3).cast("int").alias("page"))
    pages = pages.withColumn("rows", F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':') for c in SCHEMA.split(', '))}>>"))
    bad = pages.groupBy("kind", "name").agg(F.count("*").alias("n"), F.max("page").alias("last"), F.bool_or(F.col("rows").isNull() | ~F.startswith(F.ltrim("value"), F.lit("["))).alias("broken")).where("broken or n <> last")
    first = bad.orderBy("kind", "name").first()
    if first is not None:
        raise ValueError(f"the pages of {first['kind']} {first['name']} are not whole")
    rows = pages.select("kind", "name", "page", F.posexplode("rows").alias("place", "r"))
    return rows.select("kind", "name", "page", "place", "r.*").orderBy("kind", "name", "page", "place")


def save_page(rows: list[dict]) -> str:
    """A page as ``read_pages`` reads it."""
    return json.dumps(rows)
