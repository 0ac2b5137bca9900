"""Where scratch tables go."""

from types import SimpleNamespace

import pytest

from vulnspark.session import scratch_path


def session(folder, master="local[2]"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_the_cluster_names_the_folder():
    one, two = (scratch_path(session("hdfs://shared/ckpt/"), "t") for _ in range(2))
    assert one.startswith("hdfs://shared/ckpt/t-") and one != two


def test_a_local_run_takes_one_temporary_folder():
    one, two = (scratch_path(session(None), "t") for _ in range(2))
    assert one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0] and one != two


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError):
        scratch_path(session(None, "yarn"), "t")
