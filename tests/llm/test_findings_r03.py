"""Cases of the findings of round 3."""

import pyarrow as pa

from wardline.llm import language_id


def test_texts_are_unpacked_in_small_steps(monkeypatch):
    monkeypatch.setattr(language_id, "SLICE_CHARS", 10)
    column = pa.array(["abcd", None, "ab", "é" * 30, "", "x"])
    assert list(language_id._slices(column)) == [(0, 4), (4, 6)]
    assert list(language_id._slices(pa.array([], pa.string()))) == []
