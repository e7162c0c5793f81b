"""What finished steps leave behind at the driver is collected between the steps."""

import re
from types import SimpleNamespace

import pytest

from failtriage import session


def test_each_written_step_may_collect(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(session, "release", calls.append)
    assert session.materialize(spark.range(3), "three").count() == 3
    assert len(calls) == 1


@pytest.mark.parametrize(("taken", "collected"), [(300, []), (500, ["gc", "trim"])])
def test_garbage_is_collected_when_the_heap_has_grown(monkeypatch, taken, collected):
    calls = []
    monkeypatch.setattr(session, "trim", lambda spark: calls.append("trim"))
    heap = SimpleNamespace(totalMemory=lambda: taken, maxMemory=lambda: 1000)
    lang = SimpleNamespace(
        Runtime=SimpleNamespace(getRuntime=lambda: heap), System=SimpleNamespace(gc=lambda: calls.append("gc"))
    )
    monkeypatch.setitem(session._trimmed, "at", float("-inf"))
    session.release(SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang))))
    assert calls == collected


def test_free_native_memory_is_given_back(spark):
    version = spark._jvm.java.lang.System.getProperty("java.version")
    if tuple(map(int, re.findall(r"\d+", version)[:3])) < (17, 0, 9):
        pytest.skip("this Java has no such command")
    assert session.trim(spark)
