"""Parameters from variables and options; backends that load and clean up once a task."""

import os
import sys
import uuid

import numpy as np
import pytest
from pyspark import cloudpickle

from momentlens.plans import moments, parameters
from momentlens.sources import backends

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_order_of_sources():
    env = {"M_FPS": "4", "M_DISTANCE": " 7 ", "M_SMOOTH": "", "FPS": "9"}
    p, rest = parameters.parameters(moments.FOUR, ["--distance", "12", "films", "--percentile=0.5", "--", "--x"], "m_", env)
    assert (p.fps, p.distance, p.smooth, p.percentile, rest) == (4.0, 12, 6, 0.5, ["films", "--x"])
    assert p.weights == moments.FOUR.weights
    c = parameters.from_environment(moments.Condense(), env={"TARGET": "30.5"})
    assert c.target == 30.5 and c.profile == moments.THREE


@pytest.mark.parametrize("arguments", [["--nothing", "1"], ["--fps"], ["--fps", "fast"], ["--distance=1.5"]])
def test_wrong_options(arguments):
    with pytest.raises(ValueError):
        parameters.from_arguments(moments.FOUR, arguments)


def test_wrong_variables():
    with pytest.raises(ValueError, match="FPS"):
        parameters.from_environment(moments.FOUR, env={"FPS": "x"})
    with pytest.raises(TypeError):
        parameters.from_environment(3)


class Counting(backends.HashBackend):
    def __init__(self, folder, fails=False):
        super().__init__(4)
        self.folder, self.fails = folder, fails

    def _note(self, what):
        with open(f"{self.folder}/{what}-{uuid.uuid4().hex}", "w"):
            pass

    def load(self):
        self._note("load")

    def cleanup(self):
        self._note("cleanup")

    def embed_clips(self, clips):
        if self.fails:
            raise RuntimeError("no such clip")
        return super().embed_clips(clips)


def notes(folder):
    return sorted(x.split("-")[0] for x in os.listdir(folder))


def test_clips(spark, tmp_path):
    rows = [("a", float(i), i + 30.0, 1) for i in range(40)] + [(None, 0.0, 1.0, 1), ("b", 5.0, 5.0, 1), ("b", None, 5.0, 1)]
    d = spark.createDataFrame(rows, "source string, start double, end double, embedding int").repartition(3)
    got = backends.embedded_clips(d, Counting(str(tmp_path))).collect()
    assert len(got) == 40 and notes(tmp_path) == ["cleanup"] * 3 + ["load"] * 3
    want = backends.HashBackend(4).embed_clips([backends.Clip("a", 7.0, 37.0)])[0]
    assert np.allclose([r for r in got if r["start"] == 7][0]["embedding"], want)


def test_cleanup_after_a_failure(spark, tmp_path):
    d = spark.createDataFrame([("a", 0.0, 1.0)], "source string, start double, end double").coalesce(1)
    with pytest.raises(Exception, match="no such clip"):
        backends.embedded_clips(d, Counting(str(tmp_path), True)).collect()
    assert notes(tmp_path) == ["cleanup", "load"]


def test_texts_only(spark):
    class Texts(backends.Backend):
        dims = 2

        def embed(self, inputs):
            return np.ones((len(inputs), 2), np.float32)

    d = spark.createDataFrame([("a", 0.0, 1.0, None)], "source string, start double, end double, note string")
    assert backends.embedded(d, "note", Texts()).first()["embedding"] == [1.0, 1.0]
    with pytest.raises(Exception, match="embeds texts only"):
        backends.embedded_clips(d, Texts()).collect()
