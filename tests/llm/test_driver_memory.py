"""What stages and fitting leave behind on the driver."""

import ctypes
import re
from pathlib import Path
from types import SimpleNamespace

import pytest

from strandlake import session
from strandlake.llm import common, toxicity


@pytest.mark.parametrize("total, collected", [(300, 0), (375, 0), (376, 1), (750, 1)])
def test_a_grown_heap_is_collected(total, collected):
    done = []
    heap = SimpleNamespace(totalMemory=lambda: total << 20, maxMemory=lambda: 750 << 20, gc=lambda: done.append(1))
    runtime = SimpleNamespace(getRuntime=lambda: heap)
    session.spare_driver(SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=runtime)))))
    assert len(done) == collected


def test_stages_look_at_the_heap(spark, rows, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "spare_driver", lambda s: (seen.append(s), session.spare_driver(s)), raising=False)
    staged = common.stage(rows([(1,), (2,)], "doc_id long"), "memory")
    assert sorted(r.doc_id for r in staged.collect()) == [1, 2] and len(seen) == 1


def own_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists() or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs Linux and glibc")
def test_fitting_gives_its_memory_back(rows, monkeypatch):
    last = []

    def fit(texts, labels, **options):
        freed = [b"x" * 100_000 for _ in range(800)]
        last.append(b"y" * 100_000)  # above what is freed, so the C library keeps all that is below
        del freed
        return toxicity.Field(4)

    monkeypatch.setattr(toxicity, "fit", fit)
    docs = rows([(i, f"text {i}") for i in range(10)], "doc_id long, text string")
    before = own_mb()
    toxicity.fitted(docs, rows([(i, i % 2) for i in range(10)], "doc_id long, toxic int"))
    assert len(last) == 1 and own_mb() - before < 40
