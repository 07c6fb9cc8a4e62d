import tracemalloc

import numpy as np

from folioloom.llm import lm


def _loss(net, windows, group):
    """Mean cross entropy of a window's targets, written plainly, in doubles."""
    net = {n: w.astype(np.float64) for n, w in net.items()}
    total, n, half = 0.0, 0, lm.SPAN // 2
    for row in windows:
        x = net["emb"][row[: lm.SPAN]] + net["pos"]
        for t in range(half, lm.SPAN):
            if row[t + 1] < lm.OUT:
                seen = x[: t + 1]
                e = np.exp((seen @ net["k"]) @ (x[t] @ net["q"]) * lm.DIM**-0.5)
                z = np.r_[x[t], e / e.sum() @ (seen @ net["v"])] @ net["out"] + net["bias"]
                total -= z[group[row[t + 1]]] - np.log(np.exp(z).sum())
                n += 1
    return total / n


def _case(n):
    rng = np.random.default_rng(3)
    windows = rng.integers(0, 50, (n, lm.SPAN + 1)).astype(np.int32)
    windows[0, 12:] = lm.OUT  # a text that ends
    group = np.r_[np.arange(lm.OUT) % lm.CLASSES, 0]
    return windows, group, lm._fresh(np.full(lm.CLASSES, 1 / lm.CLASSES), rng)


def test_gradients_are_those_of_the_loss():
    windows, group, net = _case(3)
    kept = {n: w.copy() for n, w in net.items()}
    fit = lm._Adam(net, group)
    assert fit.step(windows, 0.0) == int((windows[:, lm.SPAN // 2 + 1 :] < lm.OUT).sum())
    assert all((fit.net[n] == kept[n]).all() and (net[n] == kept[n]).all() for n in kept)  # a rate of 0 moves nothing
    grads = {n: fit.grad[n] for n in ("emb", "pos", "q")} | {"k": fit.grad["kv"][:, : lm.DIM], "v": fit.grad["kv"][:, lm.DIM :], "out": fit.grad["weights"][:-1], "bias": fit.grad["weights"][-1]}
    rng = np.random.default_rng(4)
    for name, g in grads.items():
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape), tuple(rng.integers(0, s) for s in g.shape)]:
            up, down = ({n: w.astype(np.float64) for n, w in kept.items()} for _ in range(2))
            up[name][at] += 1e-4
            down[name][at] -= 1e-4
            assert abs((_loss(up, windows, group) - _loss(down, windows, group)) / 2e-4 - g[at]) < 1e-4, (name, at)


def test_a_step_works_in_arrays_that_are_made_once():
    windows, group, net = _case(lm._SIZE)
    fit = lm._Adam(net, group)
    fit.step(windows, 0.01)
    tracemalloc.start()
    fit.step(windows, 0.01)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_500_000  # 4.9 MB when every step made its own arrays


def test_steps_of_several_sizes_follow_each_other():
    windows, group, net = _case(40)
    mixed, alone = lm._Adam(net, group), lm._Adam(net, group)
    mixed.step(windows, 0.0)
    mixed.step(windows[:7], 0.0)
    alone.step(windows[:7], 0.0)
    assert np.allclose(mixed.g, alone.g, atol=1e-7)
