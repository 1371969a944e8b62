import glob
import os

import pytest

from skerry.sources import store as S

SCHEMAS = {"a": "id long, path string, v string", "b": "path string, n long"}


@pytest.fixture
def deltas(spark, tmp_path):
    return lambda: S.Deltas(spark, f"{tmp_path}/index", SCHEMAS, "path")


def save(spark, deltas, paths, value, gone=()):
    """Rows of ``paths`` come, those of them and of ``gone`` go."""
    rows = spark.createDataFrame([(i, p, value) for i, p in enumerate(paths)], SCHEMAS["a"])
    counts = spark.createDataFrame([(p, len(value)) for p in paths], SCHEMAS["b"])
    keys = spark.createDataFrame([(p,) for p in [*paths, *gone]], "path string")
    deltas().save({"a": rows, "b": counts}, {"a": keys, "b": keys}, 1.0)


def now(deltas):
    a = {r["path"]: r["v"] for r in deltas().load("a").collect()}
    assert {r["path"]: r["n"] for r in deltas().load("b").collect()} == {p: len(v) for p, v in a.items()}
    return a


def bytes_of(tmp_path):
    return {f: os.path.getsize(f) for f in glob.glob(f"{tmp_path}/index/data/**/*.parquet", recursive=True)}


def test_saves_against_a_dictionary(spark, deltas, tmp_path):
    assert not deltas().exists and now(deltas) == {}
    want = {}
    for n in range(2 * S.COMPACT + 5):
        paths, gone = [f"p{(n * 7 + k) % 11}" for k in range(n % 4)], [f"p{n % 5}"]
        gone = [g for g in gone if g not in paths]
        save(spark, deltas, paths, f"save{n}", gone)
        want = {p: v for p, v in want.items() if p not in gone} | dict.fromkeys(paths, f"save{n}")
        assert now(deltas) == want and deltas().number == n + 1
    # two compactions: what is before the first of them is gone
    saves = {int(x.removeprefix("save=")) for x in os.listdir(tmp_path / "index/data/a")}
    assert min(saves) > 1 and deltas().size() > 0
    deltas().clear()
    assert not deltas().exists and deltas().size() == 0


def test_a_small_save_writes_little(spark, deltas, tmp_path):
    save(spark, deltas, [f"p{i:06}" for i in range(50_000)], "text of some length")
    before = bytes_of(tmp_path)
    save(spark, deltas, ["p000007"], "changed")
    new = {f: n for f, n in bytes_of(tmp_path).items() if f not in before}
    assert sum(new.values()) < 0.1 * sum(before.values()) and {f: n for f, n in bytes_of(tmp_path).items() if f in before} == before
    got = now(deltas)
    assert got["p000007"] == "changed" and len(got) == 50_000


def test_readers_of_an_earlier_save_finish(spark, deltas):
    save(spark, deltas, ["x", "y"], "old")
    reader = deltas().load("a")
    for n in range(S.COMPACT + 1):  # up to a compaction
        save(spark, deltas, ["x"], f"new{n}", ["y"])
    assert {r["path"]: r["v"] for r in reader.collect()} == {"x": "old", "y": "old"} and now(deltas) == {"x": f"new{S.COMPACT}"}


def test_a_save_that_fails_changes_nothing(spark, deltas, monkeypatch):
    save(spark, deltas, ["x", "y"], "first")
    write = S.Deltas._write

    def fails(self, df, name, number):
        write(self, df, name, number)
        if name == "b":
            raise RuntimeError("lost")

    monkeypatch.setattr(S.Deltas, "_write", fails)
    with pytest.raises(RuntimeError):
        save(spark, deltas, ["x", "z"], "second")
    assert now(deltas) == {"x": "first", "y": "first"}
    monkeypatch.setattr(S.Deltas, "_write", write)
    save(spark, deltas, ["w"], "third")  # takes the failed save's number, and none of its rows
    assert now(deltas) == {"x": "first", "y": "first", "w": "third"}


def test_another_version_and_a_broken_pointer(spark, deltas, tmp_path):
    save(spark, deltas, ["x"], "v")
    (tmp_path / "index/CURRENT.json").write_text('{"version": 1, "snapshot": "data"}')
    assert deltas().broken and not deltas().exists and now(deltas) == {}
