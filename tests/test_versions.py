"""Tables that change as a whole: readers during a swap, writers of one version, several tables at once."""

import json
import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lumicat.sources import versions
from lumicat.sources.versions import Change


def rows(spark, *triples):
    return spark.createDataFrame(list(triples), "p string, k int, v long")


def held(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_partitions_are_swapped(spark, tmp_path):
    base = str(tmp_path)
    first = [("a", 1, 1), ("a", 2, 1), ("b", 3, 1), (None, 4, 1), ("c/d=é", 5, 1)]
    one = versions.publish(spark, base, {"t": Change(rows(spark, *first), "p")})
    two = versions.publish(spark, base, {"t": Change(rows(spark, ("a", 9, 2), (None, 8, 2), ("new", 7, 2)), "p", drop=("b",))})
    assert (one.number, two.number) == (1, 2)
    assert held(versions.read(spark, base, "t")) == sorted([("a", 9, 2), (None, 8, 2), ("new", 7, 2), ("c/d=é", 5, 1)], key=repr)
    assert held(versions.read(spark, base, "t", one)) == sorted(first, key=repr) == held(versions.read(spark, base, "t", versions.version(spark, base, 1)))
    versions.publish(spark, base, {"t": Change(rows(spark).limit(0), "p", drop=("a", "new", None, "c/d=é"))})
    assert held(versions.read(spark, base, "t")) == []


def test_a_reader_sees_old_or_new(spark, tmp_path):
    """Two tables always change together; a reader that asks all the time never sees them apart."""
    base = str(tmp_path)
    parts = ["x", "y", "z"]
    both = lambda n: {t: Change(rows(spark, *[(p, n, n) for p in parts]), "p") for t in ("t", "u")}
    versions.publish(spark, base, both(0))
    seen, stop = [], threading.Event()

    def watch():
        while not stop.is_set():
            at = versions.version(spark, base)
            seen.append(tuple(sorted({r.v for t in ("t", "u") for r in versions.read(spark, base, t, at).collect()})))

    reader = threading.Thread(target=watch)
    reader.start()
    for n in range(1, 6):
        versions.publish(spark, base, both(n))
    stop.set()
    reader.join()
    assert len(seen) > 3 and all(len(s) == 1 for s in seen) and [s[0] for s in seen] == sorted(s[0] for s in seen)


def test_two_writers(spark, tmp_path):
    base = str(tmp_path)
    start = versions.publish(spark, base, {"t": Change(rows(spark, ("a", 1, 1)), "p")})
    versions.publish(spark, base, {"t": Change(rows(spark, ("b", 2, 2)), "p")}, start)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, base, {"t": Change(rows(spark, ("b", 3, 3)), "p")}, start)
    assert held(versions.read(spark, base, "t")) == [("a", 1, 1), ("b", 2, 2)]
    again = versions.publish(spark, base, {"t": Change(rows(spark, ("b", 3, 3)), "p")})
    assert again.number == 3 and held(versions.read(spark, base, "t")) == [("a", 1, 1), ("b", 3, 3)]


def test_a_writer_that_dies(spark, tmp_path, monkeypatch):
    """What was written and not published is seen by nobody; its claim can be given up."""
    base = str(tmp_path)
    versions.publish(spark, base, {"t": Change(rows(spark, ("a", 1, 1)), "p")})

    def dies(_):
        raise OSError("gone")

    monkeypatch.setattr(versions, "json", SimpleNamespace(loads=json.loads, dumps=dies))
    with pytest.raises(OSError, match="gone"):
        versions.publish(spark, base, {"t": Change(rows(spark, ("a", 2, 2)), "p")})
    monkeypatch.undo()
    assert held(versions.read(spark, base, "t")) == [("a", 1, 1)]
    with pytest.raises(versions.Conflict):
        versions.publish(spark, base, {"t": Change(rows(spark, ("a", 3, 3)), "p")})
    versions.release(spark, base, 2)
    assert versions.publish(spark, base, {"t": Change(rows(spark, ("a", 3, 3)), "p")}).number == 2
    versions.release(spark, base, 2)  # published: stays
    assert held(versions.read(spark, base, "t")) == [("a", 3, 3)]


def test_whole_tables_and_vacuum(spark, tmp_path):
    base = str(tmp_path)
    versions.publish(spark, base, {"t": Change(rows(spark, ("a", 1, 1))), "s": Change(rows(spark, ("q", 1, 1)), "p")})
    versions.publish(spark, base, {"t": Change(rows(spark, ("a", 2, 2)).withColumn("more", F.lit(1)))})
    with pytest.raises(ValueError, match="partitions"):
        versions.publish(spark, base, {"t": Change(rows(spark, ("a", 3, 3)).withColumn("more", F.lit(1)), "p")})
    with pytest.raises(ValueError, match="schema"):
        versions.publish(spark, base, {"s": Change(rows(spark, ("a", 3, 3)).withColumn("more", F.lit(1)), "p")})
    versions.publish(spark, base, {"s": Change(rows(spark, ("r", 1, 1)), "p")})
    assert len(versions.vacuum(spark, base, 2)) == 1
    assert held(versions.read(spark, base, "t").drop("more")) == [("a", 2, 2)] and held(versions.read(spark, base, "s")) == [("q", 1, 1), ("r", 1, 1)]
    assert versions.version(spark, str(tmp_path / "none")).number == 0
