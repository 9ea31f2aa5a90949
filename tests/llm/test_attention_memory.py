"""What a training step and an encoding worker hold at once."""

import tracemalloc

import numpy as np

from panelwright.llm import attention


def test_a_step_works_on_some_windows_at_a_time():
    r = np.random.default_rng(3)
    m = attention.fresh(500)
    m["ids"] = np.ones(500, np.float32)
    seen, goal, _, _ = attention.windows([r.integers(3, 500, 60_000)])
    t = attention.Trainer(m, 0.08)
    t.step(seen[:200], goal[:200])
    tracemalloc.start()
    t.step(seen, goal)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(seen) > 3_700 and peak < 16 << 20


def test_a_step_is_the_same_however_it_is_cut(monkeypatch):
    r = np.random.default_rng(4)
    m = attention.fresh(90)
    m["ids"] = np.ones(90, np.float32)
    seen, goal, _, _ = attention.windows([r.integers(3, 90, n) for n in (0, 5, 700, 41)])
    out = []
    for size in (7, 10_000):
        monkeypatch.setattr(attention, "PIECE", size)
        t = attention.Trainer(m, 0.08)
        losses = [t.step(seen, goal) for _ in range(3)]
        out.append((losses, t.m["e"], t.m["own"], t.got, t.used))
    for a, b in zip(*out):
        assert np.allclose(a, b, atol=1e-4)
