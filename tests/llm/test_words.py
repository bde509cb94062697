import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from commentlens.llm import words as W

TEXT = st.text(alphabet=st.sampled_from(list("aB é\n\t\x0b\x0c\r1.ü") + [" ", "\U0001f600"]), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_of_a_batch(texts):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = []
    for rows, data, offsets in W.slices(batch):
        w = W.Words(data, offsets)
        assert len(w.counts) == rows.num_rows
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            got.append([bytes(data[w.starts[k] : w.ends[k]]).decode() for k in range(a, b)])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_names_follow_the_bytes_only():
    texts = ["alpha betabetabeta x", "x\nalpha", "A" * 3000 + " " + "A" * 3000, "a" * 3000]
    data = "".join(texts).encode()
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    w = W.Words(np.frombuffer(data, np.uint8), offsets)
    assert w.names[0] == w.names[4] and w.names[2] == w.names[3] and w.names[5] == w.names[6]
    assert len(set(w.names.tolist())) == 5
    lower = W.Words(np.frombuffer(data, np.uint8), offsets, lower=True)
    assert lower.names[5] == lower.names[7]


def test_slices_cut_between_rows(monkeypatch):
    monkeypatch.setattr(W, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["abcdefgh", None, "x" * 30, "", "yz"]})
    parts = [(rows.num_rows, bytes(data)) for rows, data, _ in W.slices(batch)]
    assert sum(n for n, _ in parts) == 5 and b"".join(d for _, d in parts) == b"abcdefgh" + b"x" * 30 + b"yz"
