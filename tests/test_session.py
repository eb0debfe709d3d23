"""The shared folder with and without spark.checkpoint.dir."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from textquarry.session import qualified, shared_folder

UNSET = """
from textquarry.session import local_session, shared_folder
from textquarry.sources.tables import saved
spark = local_session(1, 1, "unset")
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = shared_folder(spark)
assert first == shared_folder(spark) and first.startswith("file:///"), first
assert saved(spark.range(3)).count() == 3
print("fine")
"""


def test_a_plain_local_session_gets_a_folder(tmp_path):
    out = subprocess.run([sys.executable, "-c", UNSET], env={**os.environ, "SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=180, check=False)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]


def test_paths_get_their_scheme(spark):
    assert qualified(spark, "/some/folder/") == "file:///some/folder"
    assert qualified(spark, "file:/some/folder") == qualified(spark, "file:///some/folder") == "file:///some/folder"
    assert "://" in shared_folder(spark)


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://somewhere:7077", "app"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Cluster)
