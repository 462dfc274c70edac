"""python -m vintagraph.llm.recall N...: share of the 5 true nearest that lie in the probed lists, on N made-up vectors of 64 values.

Without Spark: the fit, the lists and the probes of the operator, 300 queries against brute force. Vectors are noisy
copies of a centre each, with N / 50 centres.
"""

import sys
import time

import numpy as np

from vintagraph.llm import neighbours as nb


def main(n: int) -> None:
    rng = np.random.default_rng(n)
    c = rng.standard_normal((max(1, n // 50), 64), dtype=np.float32)
    x = c[rng.integers(0, len(c), n)] + 0.5 * rng.standard_normal((n, 64), dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = time.time()
    lists = int(max(1, min(round(n**0.5), nb.SAMPLE / nb.EACH, n)))
    cs = nb.Centres(x[rng.permutation(n)[: nb.SAMPLE]], lists)
    fit, t = time.time() - t, time.time()
    home = np.concatenate([cs.nearest(x[i : i + 2048], 1)[:, 0] for i in range(0, n, 2048)])
    q = rng.permutation(n)[:300]
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -2
    true = np.argpartition(-s, 5, axis=1)[:, :5]
    probed = cs.nearest(x[q], min(nb.PROBES, len(cs)))
    hit = (home[true][:, :, None] == probed[:, None, :]).any(axis=2).mean()
    share = np.bincount(home, minlength=len(cs))[probed].sum(axis=1).mean() / n
    print(f"{n} vectors, {len(cs)} lists, {nb.PROBES} probes: recall {hit:.4f}, {share:.4f} of the vectors compared, fit {fit:.0f} s, lists {time.time() - t:.0f} s", flush=True)


if __name__ == "__main__":
    for arg in sys.argv[1:]:
        main(int(arg))
