"""What tasks get has to load where this package is not installed."""

import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from evidentia.operators import digests, slopes
from evidentia.sources import paged
from evidentia.streaming import keyed


def test_pickles_load_without_the_package(tmp_path):
    things = [keyed.Snapshots(["k"], 1), keyed.Alerts("k", 1), slopes.medians(["k"]), digests._running(1, b"|"), paged.Pages, paged.Page("p", "c")]
    (tmp_path / "things").write_bytes(cloudpickle.dumps(things))
    code = "import pickle, sys; sys.path[:] = [p for p in sys.path if p and 'repo' not in p]\ntry:\n import evidentia\nexcept ImportError:\n print(len(pickle.load(open('things', 'rb'))))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": ""}, capture_output=True, text=True, check=False)
    assert out.stdout.strip() == str(len(things)), out.stderr


def test_udf_in_a_session(spark):
    assert spark.range(1).select(digests.canonical_json_text(F.lit('{"b":1, "a":2}'))).first()[0] == '{"a":2,"b":1}'


def test_postings_load_without_the_package(tmp_path):
    from evidentia.operators import prefixes

    (tmp_path / "things").write_bytes(cloudpickle.dumps(prefixes.postings(0.6, None)))
    code = "import pickle, sys; sys.path[:] = [p for p in sys.path if p and 'repo' not in p]\ntry:\n import evidentia\nexcept ImportError:\n print(pickle.load(open('things', 'rb')).__name__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": ""}, capture_output=True, text=True, check=False)
    assert out.stdout.strip() == "run", out.stderr
