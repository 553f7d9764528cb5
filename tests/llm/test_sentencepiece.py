"""Merge dropout draws anew at every occurrence."""

import collections
import random

import numpy as np

from tidewatch.llm import sentencepiece_codec as sc


def test_every_occurrence_draws_anew():
    codec = sc.Codec(sc.model_path())
    got, unvaried = collections.Counter(), 0
    path: list = []
    codec.cut_ids(" sometimes", 0, False, path)
    assert len(path) == 9
    for d in range(40):
        keys = codec.keys(d, 200)
        for k in keys:
            got[tuple(codec.cut_ids(" sometimes", int(k)))] += 1
            unvaried += not any(codec.skipped(int(k), what) for what in path)
        want = np.concatenate([np.array(codec.cut_ids(" sometimes", int(k)), "<u4") for k in keys])
        # what was met before changes nothing
        assert codec.encode(" ".join(["sometimes"] * 200), d) == want.tobytes()
    assert len(got) > 4
    assert abs(unvaried / 8000 - 0.9**9) < 0.03  # nine merges make the word one piece


def test_memory_that_is_cleared_and_long_cuts(monkeypatch):
    text = "one two three " + "x" * 100 + " one\n two  three " * 50
    whole = sc.Codec(sc.model_path()).encode_all([text, "", text], [1, 2, 3])
    monkeypatch.setattr(sc, "REMEMBERED", 3)
    monkeypatch.setattr(sc, "PASS_CUTS", 7)
    codec = sc.Codec(sc.model_path())
    assert [codec.encode(t, k) for t, k in ((text, 1), ("", 2), (text, 3))] == whole == codec.encode_all([text, "", text], [1, 2, 3])
    assert whole[0] != whole[2] and codec.decode(whole[0]) == text


def test_shared_agendas_give_what_single_ones_give():
    """Against one agenda for each cut, over odd characters and lengths around the longest that share one."""
    draw = random.Random(5)
    letters = ["e", "n", "th", "er", " ", "  ", "\n", "\u2581", "\u00e9", "\u4e2d", "\ud55c", "\U0001f600", "\x00", "1", "ing", "t"]
    for dropout in (0.0, 0.1, 0.9):
        codec = sc.Codec(sc.model_path(), dropout)
        texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 200))) for _ in range(150)]
        texts += ["en" * n for n in (sc.LONGEST // 2 - 1, sc.LONGEST // 2, sc.LONGEST // 2 + 1)]
        got = codec.encode_all(texts, list(range(len(texts))))
        for d, (text, ids) in enumerate(zip(texts, got, strict=True)):
            cuts = sc._CUT.findall(" " + text) if text else []
            want = [i for cut, key in zip(cuts, codec.keys(d, len(cuts)).tolist(), strict=True) for i in codec.cut_ids(cut, key)]
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert codec.decode(ids) == text
