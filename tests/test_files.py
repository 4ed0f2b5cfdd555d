"""The two file sources: contents of listed files, and changes as a stream."""

import os
import shutil
import time
from collections import Counter
from types import SimpleNamespace

import pytest

from claimweave.sources import derived, listing
from claimweave.sources import files as source


def put(root, path, content="x"):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(content)


# --- contents ----------------------------------------------------------------------------------------------------------


def test_contents_and_errors(spark, tmp_path):
    put(tmp_path, "a/one.pdf", "1")
    put(tmp_path, "a/odd {name}[1] %20.pdf", "odd")
    put(tmp_path, "a/not asked for.pdf")
    put(tmp_path, "b/empty.pdf", "")
    (tmp_path / "b" / "folder.pdf").mkdir()
    names = ["a/one.pdf", "a/odd {name}[1] %20.pdf", "b/empty.pdf", "b/folder.pdf", "c/gone.pdf", "a/one.pdf"]
    found = source.read_contents(spark.createDataFrame([(n,) for n in names], "relative_path string"), f"file://{tmp_path}").collect()
    assert {r.relative_path: r.content and bytes(r.content) for r in found} == {
        "a/one.pdf": b"1", "a/odd {name}[1] %20.pdf": b"odd", "b/empty.pdf": b"", "b/folder.pdf": None, "c/gone.pdf": None,
    }
    errors = {r.relative_path: r.read_error for r in found if r.read_error}
    assert set(errors) == {"b/folder.pdf", "c/gone.pdf"} and errors["c/gone.pdf"].startswith("FileNotFoundError: ")
    assert source.read_contents(spark.createDataFrame([], "relative_path string, size long"), str(tmp_path)).collect() == []


def test_opened_files_are_the_listed_ones(spark, tmp_path, monkeypatch):
    """20,000 of 20,400 files: every task opens its part of the list, each file once."""
    for folder in range(200):
        (tmp_path / f"f{folder}").mkdir()
        for number in range(102):
            (tmp_path / f"f{folder}" / f"{number}.pdf").write_text(f"{folder} {number}")
    files = listing.read_directory(spark, str(tmp_path)).filter("relative_path NOT LIKE '%/100.pdf' AND relative_path NOT LIKE '%/101.pdf'")
    stored = {}
    monkeypatch.setattr(source, "stored", lambda rows, purpose: stored.setdefault("path", plain(rows, purpose)))
    plain = __import__("claimweave.session", fromlist=["stored"]).stored
    found = source.read_contents(files, str(tmp_path))
    assert found.rdd.getNumPartitions() == 20
    assert {r.relative_path: bytes(r.content).decode() for r in found.collect()} == {f"f{a}/{b}.pdf": f"{a} {b}" for a in range(200) for b in range(100)}

    opened = Counter()
    monkeypatch.setattr(source, "read_file", lambda _, path: (opened.update([path]), (b"", None))[1])
    reader = source.ListedFilesReader({"root": str(tmp_path), "listing": stored["path"]})
    sizes = [sum(batch.num_rows for batch in reader.read(part)) for part in reader.partitions()]
    assert len(sizes) == 20 and max(sizes) < 1_500
    assert opened == {f"{tmp_path}/f{a}/{b}.pdf": 1 for a in range(200) for b in range(100)}


def test_large_files_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source, "PART_BYTES", 1_000)
    for number in range(10):
        put(tmp_path, f"a/{number}.pdf", "x" * 500)
    assert source.read_contents(listing.read_directory(spark, str(tmp_path)), str(tmp_path)).rdd.getNumPartitions() == 5


def test_an_error_that_is_not_about_the_file_ends_the_job(monkeypatch):
    class Broken:
        def open_input_file(self, path):
            raise problem

        def get_file_info(self, path):
            return SimpleNamespace(is_file=there)

    there, problem = True, OSError(5, "input/output error")
    with pytest.raises(OSError):
        source.read_file(Broken(), "x")
    there = False
    assert source.read_file(Broken(), "x")[1].startswith("OSError: ")
    problem = PermissionError("not yours")
    assert source.read_file(Broken(), "x") == (None, "PermissionError: not yours")


# --- changes -----------------------------------------------------------------------------------------------------------


@pytest.fixture
def stage(spark, tmp_path):
    root = tmp_path / "stage"
    root.mkdir()

    def run(seen, fail=False, checkpoint="checkpoint"):
        """One start of the stream over what has changed; rows that came are added to `seen`."""

        def keep(batch, _):
            rows = [(r.relative_path, r.action, r.size) for r in batch.collect()]
            again = [(r.relative_path, r.action, r.size) for r in batch.collect()]  # a second action over the batch sees the same
            assert sorted(rows) == sorted(again)
            seen.extend(rows)
            if fail:
                raise RuntimeError("broken off")

        changes = source.stream_files(spark, str(root), str(tmp_path / f"{checkpoint}-state"), parts=3)
        query = changes.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()

    return root, run, tmp_path


def test_insert_overwrite_delete_with_restarts_between(stage):
    root, run, _ = stage
    for name in ("a/x.pdf", "a/y.pdf", "b/z.pdf", "top.pdf", "a/.hidden", "_c/x.pdf"):
        put(root, name)
    seen = []
    run(seen)
    assert sorted(seen) == [("a/x.pdf", "INSERT", 1), ("a/y.pdf", "INSERT", 1), ("b/z.pdf", "INSERT", 1), ("top.pdf", "INSERT", 1)]
    seen.clear()
    run(seen)
    assert seen == []
    put(root, "a/x.pdf", "longer")  # overwritten with another size
    time.sleep(0.01)
    put(root, "a/y.pdf", "y")  # with the same size at another time
    run(seen)
    assert sorted(seen) == [("a/x.pdf", "INSERT", 6), ("a/y.pdf", "INSERT", 1)]
    seen.clear()
    (root / "a/x.pdf").unlink()
    shutil.rmtree(root / "b")
    put(root, "d/new.pdf")
    run(seen)
    assert sorted(seen) == [("a/x.pdf", "DELETE", 0), ("b/z.pdf", "DELETE", 0), ("d/new.pdf", "INSERT", 1)]
    seen.clear()
    put(root, "a/x.pdf", "back")
    run(seen)
    assert seen == [("a/x.pdf", "INSERT", 4)]


def test_a_batch_that_broke_off_is_given_again(stage):
    """Changes that came between the failure and the restart are in the batch after it."""
    root, run, _ = stage
    put(root, "a/x.pdf")
    put(root, "a/y.pdf")
    run([])
    put(root, "a/x.pdf", "more")
    (root / "a/y.pdf").unlink()
    first, second, third = [], [], []
    with pytest.raises(Exception, match="broken off"):
        run(first, fail=True)
    put(root, "a/late.pdf")
    put(root, "a/x.pdf", "and more")
    run(second)
    run(third)
    assert sorted(first) == [("a/x.pdf", "INSERT", 4), ("a/y.pdf", "DELETE", 0)]
    assert sorted(second[:2]) == sorted(first)
    assert sorted(second[2:] + third) == [("a/late.pdf", "INSERT", 1), ("a/x.pdf", "INSERT", 8)]


def test_every_checkpoint_has_its_own_view(stage):
    root, run, folder = stage
    put(root, "a/x.pdf")
    one, other = [], []
    run(one)
    run(other, checkpoint="other")
    assert one == other == [("a/x.pdf", "INSERT", 1)]
    put(root, "a/x.pdf", "two")
    run(one)
    run(one)
    steps = sorted(os.listdir(folder / "checkpoint-state"))
    assert len(steps) <= 2  # older listings go once they are not needed
    shutil.rmtree(folder / "checkpoint-state")
    with pytest.raises(Exception):
        run(one)


def test_attempts_of_one_task_agree(tmp_path):
    """The listing that was stored first counts, whatever a later attempt of the task sees."""
    root = tmp_path / "stage"
    put(root, "a/x.pdf")
    reader = source.FileChangesReader({"root": str(root), "state": str(tmp_path / "state"), "parts": "1"})
    part = reader.partitions({"step": 0}, {"step": 1})[0]
    late = reader._scan(0)
    put(root, "a/y.pdf")
    assert [b.num_rows for b in reader.read(part)] == [2]
    files, state = source.open_root(str(tmp_path / "state"))
    source._store_once(files, late, f"{state}/step-1/0.parquet")
    assert [b.num_rows for b in reader.read(part)] == [2] and os.listdir(tmp_path / "state/step-1") == ["0.parquet"]
    assert reader.latestOffset() == {"step": 2}


def test_parts_hold_all_files(tmp_path):
    for number in range(50):
        put(tmp_path, f"f{number}/x.pdf")
    reader = source.FileChangesReader({"root": str(tmp_path), "state": "unused", "parts": "7"})
    scans = [reader._scan(number)["relative_path"].to_pylist() for number in range(7)]
    assert sorted(sum(scans, [])) == sorted(f"f{n}/x.pdf" for n in range(50)) and sum(map(bool, scans)) > 4


def test_a_listing_is_made_by_tasks(spark, tmp_path):
    """No file index of the driver and no share of a task per file: as many tasks as parts, whatever the number of files."""
    for name in ("a/one.pdf", "a/b/two.pdf", "top.pdf", "_x=1/kept.pdf", ".hidden/no.pdf", "_gone/no.pdf", "a/_no.pdf"):
        put(tmp_path, name, "12345")
    listed = listing.read_directory(spark, f"file://{tmp_path}", 3)
    assert "MapInArrow" in listed._jdf.queryExecution().executedPlan().toString() and listed.rdd.getNumPartitions() == 3
    found = {r.relative_path: r for r in listed.collect()}
    assert set(found) == {"a/one.pdf", "a/b/two.pdf", "top.pdf", "_x=1/kept.pdf"}
    assert {(r["size"], r.action) for r in found.values()} == {(5, "INSERT")}
    known = listing.directory_changes(spark, str(tmp_path), listed)
    assert known.collect() == []
    with pytest.raises(FileNotFoundError):
        listing.read_directory(spark, str(tmp_path / "absent"))


def test_texts_are_put_in_place_by_tasks(spark, tmp_path):
    """The driver commits nothing (there is no marker of it); a second writing replaces the files of its folders alone."""
    root = tmp_path / "texts"
    rows = [("d1", 1, "é"), ("d1", 1, "é"), ("a/b", 2, None), (None, None, "x")]
    texts = spark.createDataFrame(rows, "folder string, doc_id long, text string")

    def files():
        return {p.relative_to(root).as_posix(): p.read_text() for p in root.rglob("*") if p.is_file()}

    derived.write_texts(texts, str(root))
    first = files()
    assert sorted((name.split("/")[0], text) for name, text in first.items()) == [
        ("folder=__HIVE_DEFAULT_PARTITION__", "x\n"), ("folder=a%2Fb", "\n"), ("folder=d1", "é\n"), ("folder=d1", "é\n"),
    ]
    derived.write_texts(texts.filter("folder = 'a/b'"), f"file://{root}")
    second = files()
    assert {n for n in second if "d1" in n} == {n for n in first if "d1" in n} and len(second) == 4
    assert not {n for n in second if "%2F" in n} & set(first)
    derived.write_texts(texts.limit(0), str(tmp_path / "none"))
    assert listing.read_directory(spark, str(tmp_path / "none")).collect() == []
