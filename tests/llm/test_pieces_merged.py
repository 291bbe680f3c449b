"""op6 merges short chunks many at a time, with the agenda's ids, and the library's are compared with each of them."""

import numpy as np
import pytest

from lattica.llm import pieces

ALPHABET = [*"aeinorstlhAEТж日本の한!,.0123", "▁", "\n", "\r", "\t", "\x00", "é", "ß", "ing", "the", "tion", "<0x41>", "</s>", "́", "�", "퟿", "\U0001f600", "\U0010ffff"]


def test_chunks_merged_together_have_the_agendas_ids():
    m = pieces.Pieces(pieces.default_model())
    rng = np.random.default_rng(11)
    chunks = ["▁" * int(k) + "".join(rng.choice(ALPHABET, int(n))) for k, n in zip(rng.integers(1, 4, 3000), rng.integers(0, 14, 3000), strict=True)] + ["▁"]
    for some in (chunks, ["▁"], chunks[:1]):
        ids, stop = m.merge_all(some)
        assert [x.tolist() for x in np.split(ids, stop[:-1])] == [m.merge(c) for c in some]


def test_short_words_are_not_merged_one_by_one(monkeypatch):
    m = pieces.Pieces(pieces.default_model())
    one = []
    monkeypatch.setattr(m, "merge", lambda c, f=m.merge: (one.append(c), f(c))[1])
    texts = ["The thonering of\nédelle 日本 x", " two  spaces ▁ mark ", "", " ", "a " + "long" * 30 + " b", "end "]
    assert [x.tolist() for x in m.look_up(texts)] == m.library.encode(texts)
    assert one and all(len(c) > 10 for c in one)
    assert m.joined(m.look_up(texts[:1])[0]) == ",".join(map(str, m.library.encode(texts[0]))).encode() and m.joined(m.look_up([""])[0]) == b""


@pytest.mark.parametrize("word", ["thonering", "thonering" * 9])
def test_a_word_on_which_the_library_disagrees_is_an_error(monkeypatch, word):
    m = pieces.Pieces(pieces.default_model())
    m.symbol_rank[:-1] = m.symbol_rank[:-1][::-1].copy()
    m.rank = {p: -r for p, r in m.rank.items()}
    with pytest.raises(ValueError, match="the library encodes"):
        m.look_up([f"of {word} and"])
