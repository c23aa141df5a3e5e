"""Probes are packed for few queries together."""

import numpy as np

from vigilday.llm import ann


def test_probes_pack_few_vectors_together():
    rng = np.random.default_rng(1)
    x, ids = rng.standard_normal((500, 64)).astype("<f4"), np.arange(500) * 7
    row, bucket = rng.integers(0, 500, 4000), rng.integers(0, 90, 4000)
    packed = ann._pack(bucket, ids, x, row)
    packed.validate(full=True)
    for number, n, some, vecs in zip(*(c.to_pylist() for c in packed.columns)):
        at = row[bucket == number]
        assert n == len(at) and some == ids[at].astype("<i8").tobytes() and vecs == x[at].tobytes()
    # the copies a batch of queries can make, at the most buckets of each
    assert ann.PROBED * ann.PROBES * x.itemsize * 64 <= 1 << 27
    assert ann._pack(np.array([], int), np.array([], int), x[:0]).num_rows == 0
