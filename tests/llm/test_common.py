"""Shared folder, worker memories, slices of texts, and names of rows."""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
import pytest
from tabulon.llm import common


def test_a_cluster_must_name_its_shared_folder():
    unset = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://driver:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=sc))
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: "hdfs://x/shared/"), sparkContext=sc)
    assert common.shared_dir(named) == "hdfs://x/shared"


def test_a_worker_holds_one_memory_at_a_time(monkeypatch):
    monkeypatch.setattr(common, "_holder", None)
    gone = []
    common.claim("a", lambda: gone.append("a"))
    common.claim("a", lambda: gone.append("a"))
    common.claim("b", lambda: gone.append("b"))
    assert gone == ["a"]
    common.claim("a", lambda: gone.append("a"))
    assert gone == ["a", "b"]


def test_slices_cover_all_texts():
    texts = ["x" * n for n in (5, 0, 30, 1, 1)] + [None, "y"]
    found = list(common.text_slices(pa.array(texts), 10))
    assert [t for _, own in found for t in own] == [t or "" for t in texts] and [a for a, _ in found] == [0, 3]


def test_cuts_leave_no_shuffles_and_can_be_dropped(spark):
    before = spark.conf.get(common._CLEANUP)
    cut = common.Cut(spark.range(100).repartition(3, "id"), "probe")
    assert cut.df.count() == 100 and spark.conf.get(common._CLEANUP) == before
    cut.drop()
    with pytest.raises(Exception, match="does not exist|FAILED_READ_FILE|FileNotFound"):
        cut.df.collect()


def test_rows_have_names_of_their_own(spark):
    own = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert common.by_row(own, "doc_id") == (own, "doc_id")
    rows, name = common.by_row(own.union(own).union(spark.createDataFrame([(None, "c")], own.schema)), "doc_id")
    found = sorted(rows.collect(), key=lambda r: r[name])
    assert [r["doc_id"] for r in found] == [1, 1, 2, 2, None] and len({r[name] for r in found}) == 5
