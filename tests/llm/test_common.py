from types import SimpleNamespace

import pytest

from ledgerlark.llm import common


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


def test_a_named_folder_is_used():
    conf = SimpleNamespace(get=lambda key, default: "file:///shared/")
    assert common.shared_root(SimpleNamespace(conf=conf)) == "file:///shared"


def test_components_on_the_cluster_equal_those_of_the_driver(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = [sorted(map(tuple, common.components(edges, small=n).collect())) for n in (0, 1000)]
    assert got[0] == got[1] == sorted([(i, 0) for i in range(41)] + [(90, 90), (95, 90), (100, 90)])
