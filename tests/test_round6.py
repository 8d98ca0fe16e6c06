"""Faults found in the sixth round's review."""

import numpy as np
import pyarrow as pa

from clipworks.functions import sparse


def test_questions_of_a_block_are_added_up_together(monkeypatch):
    """each question sorted all the items that its features met by itself."""
    rng = np.random.default_rng(5)
    questions, items, features = 300, 200, 40
    strength = rng.integers(0, 4, (features, items))
    weight = rng.integers(1, 6, (questions, features)) * (rng.random((questions, features)) < 0.5)
    weight[:, -1] = np.where(np.arange(questions) % 3 == 0, -9, 0)  # a boost
    q, f = np.nonzero(weight)
    bias = np.arange(questions) % 2
    left = pa.table({"key": q, "kind": ["a"] * len(q), "no": f, "main": f < features - 1, "weight": weight[q, f], "bias": bias[q]})
    no, item = np.nonzero(strength)
    right = pa.table({"item": [f"i{i:03}" for i in item], "no": no, "strength": strength[no, item]})
    sorts = []
    monkeypatch.setattr(sparse.np, "unique", lambda x, *a, f=np.unique, **b: sorts.append(len(x)) or f(x, *a, **b))
    got = sparse._block("key", {"a": 5})(left, right).to_pylist()
    assert len(sorts) < questions / 10
    base, boost = weight[:, :-1] @ strength[:-1], weight[:, -1:] @ strength[-1:]
    score = base + boost + (base > 0) * bias[:, None]
    want = set()
    for k in range(questions):
        order = [i for i in np.lexsort((np.arange(items), -score[k])) if base[k, i] or boost[k, i]]
        want |= {(k, f"i{i:03}", base[k, i], boost[k, i]) for n, i in enumerate(order) if n < 5 or score[k, i] < 0}
    assert {(r["key"], r["item"], r["base"], r["boost"]) for r in got} == want and len(got) == len(want)
