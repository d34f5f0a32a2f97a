"""Listings, mirrors, frames, packing and the service."""

import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from quarry.functions.frames import Frames
from quarry.functions.regex import QueryError
from quarry.operators import index as ix, ingest
from quarry.plans.engine import Config, Engine, Service
from quarry.plans.query import Query
from quarry.sources import git, listing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark):
    return ingest.documents_as_files(spark.read.parquet(f"{SF}/documents.parquet"))


def test_listings_keep_their_order_and_stop_at_an_error():
    asked, together = [], threading.BoundedSemaphore(2)

    def get(kind, name, page):
        assert together.acquire(blocking=False)  # never more requests at a time than allowed
        try:
            asked.append((kind, name, page))
            if name == "broken" and page == 2:
                raise OSError("no answer")
            return [{"full_name": f"{name}/{page}{x}"} for x in "ab"], 1 if kind == "repo" else 3
        finally:
            together.release()

    got = [r["full_name"] for r in listing.fetch_listing(get, repos=["r"], orgs=["o", "p"], users=["u"], max_requests=2)]
    assert got == ["r/1a", *(f"{n}/{p}{x}" for n in "opu" for p in (1, 2, 3) for x in "ab")]
    with pytest.raises(OSError):
        listing.fetch_listing(get, orgs=["o", "broken"], max_requests=2)


def test_saved_pages_must_be_whole(spark, tmp_path):
    folder = tmp_path / "org" / "x"
    folder.mkdir(parents=True)
    (folder / "1.json").write_text('[{"full_name": "x/b", "fork": true}, {"full_name": "x/a"}]')
    assert [(r.full_name, r.fork, r.archived) for r in listing.read_pages(spark, str(tmp_path)).collect()] == [("x/b", True, None), ("x/a", None, None)]
    (folder / "3.json").write_text("[]")
    with pytest.raises(ValueError):
        listing.read_pages(spark, str(tmp_path))
    (folder / "2.json").write_text('{"message": "limit exceeded"}')
    with pytest.raises(ValueError):
        listing.read_pages(spark, str(tmp_path))


def test_mirrors_follow_the_remote_and_give_up_after_some_tries(spark, tmp_path):
    origin, copy = tmp_path / "origin", tmp_path / "copy"
    run = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    origin.mkdir()
    run("init", "-q", "-b", "first")
    (origin / "a").write_text("one\n")
    run("add", "-A")
    run("commit", "-qm", "1")
    assert git.mirror_all([{"remote": str(origin), "path": str(copy)}]) == ["refs/heads/first"]
    run("checkout", "-q", "-b", "second")
    (origin / "b").write_text("two\n")
    run("add", "-A")
    run("commit", "-qm", "2")
    assert git.mirror(str(origin), str(copy)) == "refs/heads/second"
    assert sorted(r.path for r in git.read_git(spark, str(copy), "HEAD", tree="t").collect()) == ["a", "b"]
    with pytest.raises(subprocess.CalledProcessError):
        git.mirror(str(tmp_path / "nothing"), str(tmp_path / "other"), tries=2, wait=0)


def test_next_fit(spark):
    sizes = [5, 5, 1, 20, 3, 3, 3, 3, 0, 10]
    df = spark.createDataFrame(list(enumerate(sizes)), "file_no long, bytes long")
    assert [r.chunk for r in ingest.next_fit(df, 10).orderBy("file_no").collect()] == [0, 0, 1, 2, 3, 3, 3, 4, 4, 5]
    assert ingest.next_fit(df.limit(0), 10).count() == 0


def test_frames(spark):
    codec = Frames()
    codec.register("a", "x int")
    with pytest.raises(ValueError):
        codec.register("a", "x int")
    with pytest.raises(QueryError):
        codec.encode("b", F.lit(1))
    rows = [('{"opcode": "a", "body": {"x": 3}}',), ('{"opcode": "other", "body": {}}',), ("no frame",), (None,)]
    df = spark.createDataFrame(rows, "f string")
    assert [(r.o, r.x) for r in df.select(codec.opcode(F.col("f")).alias("o"), codec.body("a", F.col("f"))["x"].alias("x")).collect()] == [("a", 3), (None, None), (None, None), (None, None)]


def test_service_log_is_bounded_and_stored(spark, files, tmp_path, monkeypatch):
    from quarry.plans import engine as en

    monkeypatch.setattr(en, "LOG_ROWS", 2)
    service = Service({"d": Engine(files.where("file_no < 5"))}, log_path=str(tmp_path / "log"))
    for word in ("one", "two", "three"):
        assert "error" not in service.request({"q": [word]}, session="s")
    assert sorted(r.line for r in service.query_log(spark).collect()) == ["one", "three", "two"]
    assert len(Service({}).log) == 0 and Service({}).stats()["index_age"] == -1


def test_requests_end_in_time(files):
    slow = F.arrow_udf("string")(_sleepy)
    service = Service({"d": Engine(files.withColumn("path", slow(F.col("path"))))}, Config(request_ms=1500))
    reply = service.request({"q": ["path:src"]})
    assert reply["info"]["why"] == "TIMEOUT" and reply["results"] == [] and reply["info"]["total_time"] < 20_000


def _sleepy(x):
    import time

    time.sleep(30)
    return x


def test_transformations_and_path_callbacks(files):
    e, seen, names = Engine(files), [], []
    n = e.for_each(Query(line="the"), seen.append, names.append, lambda m: m.where("lno = 1"))
    assert n == len(seen) > 0 and all(r.lno == 1 for r in seen) and names == []


def test_publishing_replaces_the_pointer(spark, files, tmp_path):
    root = str(tmp_path / "index")
    first, second = (ix.build_index(files.where(f"file_no < {n}"), root) for n in (3, 9))
    assert first != second == ix.current(spark, root) and Engine.open(spark, root).files.count() == files.where("file_no < 9").count()
    assert [p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("CURRENT")] == ["CURRENT"]
