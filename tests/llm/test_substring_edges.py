"""Strings at the edges of matches whose hashes agree in part and whose bytes differ."""

import numpy as np
import pyarrow as pa

from traceloom.llm import substrings
from traceloom.llm.hashing import Hashes

# two strings whose hashes agree in 48 bits
ONE = "dfkkedpgjhwgtajwoipmqqgciaislsffrymwkvzowaijqujqjxmiydmuffbidiqzhnitvoceqagdtfttivmtjsaqgvfssxgszqwj"
TWO = "taptzfxgeakkkcbmadkpeqvnyilphpzelfrflwankuluktzahmbgknduqsldtalqfsuftcyqvuvpfblvtmntlogimpshtxiwbpfn"


def repeated(texts):
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
    asked = pa.record_batch({
        "doc": pa.array(range(len(texts)), pa.int64()), "tie": pa.array([0] * len(texts), pa.int64()),
        "text": pa.array(texts), "asked": pa.array([[{"bucket": 0, "first": 0, "last": 0}]] * len(texts), kind)})
    rows = pa.Table.from_batches(substrings._hash_strings([asked]))
    return [r["doc"] for r in substrings._repeated_strings(rows).to_pylist()]


def test_strings_whose_hashes_agree_in_part_are_not_repeats():
    low = [int(Hashes(np.frombuffer(x.encode(), np.uint8)).all(100)[0]) & ((1 << 48) - 1) for x in (ONE, TWO)]
    assert low[0] == low[1]
    assert repeated([ONE, TWO]) == []
    assert repeated([ONE, TWO, ONE, TWO]) == [2, 3]


def test_strings_of_different_grams_are_not_compared(monkeypatch):
    """Even whole string hashes that agree make no repeat when the grams differ."""
    real = Hashes.of

    def of(self, a, b):
        h = real(self, a, b)
        return h * np.uint64(0) if np.ndim(a) and b[0] - a[0] == substrings.LENGTH else h

    monkeypatch.setattr(Hashes, "of", of)
    assert repeated([ONE, TWO]) == []
