import weakref

import numpy as np
from meshweave.llm import common


def test_memory_goes_back_when_all_is_free(monkeypatch):
    held, free = [], []
    monkeypatch.setattr(common, "give_back", lambda: free.append(held[0]() is None))

    def run(batches):
        large = np.zeros(10)
        held.append(weakref.ref(large))
        yield from batches

    assert list(common.giving_back(run)(iter([1, 2]))) == [1, 2] and free == [True]
