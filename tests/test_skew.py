"""Lookups with hot keys, and where tables between stages may go."""

from types import SimpleNamespace

import pytest

from sievework.operators import skew
from sievework.session import shared_dir


@pytest.mark.parametrize("most", [200_000, 0])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_is_a_join(spark, monkeypatch, most, how):
    monkeypatch.setattr(skew, "MOST_ROWS", most)
    monkeypatch.setattr(skew, "HOT_PARTS", 4)
    keys = [1] * 60 + [2] * 20 + [3, 4, 5] + [None] * 3
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    lookup = spark.createDataFrame([(1, "hot", 60), (2, "warm", 20), (3, "cold", 1), (9, "none", 0)], "k long, v string, n long")
    got = sorted((r["i"], r["v"] or "") for r in skew.lookup_join(rows, lookup, ["k"], "n", len(keys), how=how).collect())
    names = {1: "hot", 2: "warm", 3: "cold"}
    assert got == [(i, names.get(k, "")) for i, k in enumerate(keys) if how == "left" or k in names]


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId="app"))

    assert shared_dir(session("spark://host:7077", "hdfs://x/cp/"), "t").startswith("hdfs://x/cp/t-")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master, None), "t")
    assert "sievework-" in shared_dir(session("local[2]", None), "t")
