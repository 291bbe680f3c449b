"""Words of Latin letters, with or without marks after them, go to the tokenizer together, with its ids."""

import random

import numpy as np

from lattica.llm import packing as P


def test_words_with_marks_have_the_tokenizers_ids():
    rng = random.Random(3)
    letters, marks = "abcXYZéÉèàüÜßñçÇÀÿÞðÆö", "!\"#$%&()*+,./:;=?@^_`{}~[]\\-'<|>"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    tail = lambda: "".join(rng.choice(marks) for _ in range(rng.randint(0, 4)))
    odd = ["ó", "é!", "İ", "İ!", "don't", "l'été", "x'd#", "<|endoftext|>", "a<|endoftext|>!", "a1", "é2.", "Σ", "ﬁ.", "Å", "Å", "×", "a×b", "¿qué?", "a.̸", "≠", "a≠"]
    texts = [" ".join(word(9) + tail() if rng.random() < 0.9 else rng.choice(odd) for _ in range(rng.randint(1, 60))) for _ in range(3000)] + odd
    w = P.Words(P.default_tokenizer())
    got = [np.frombuffer(x, np.uint32).tolist() for k in range(0, len(texts), 250) for x in w.ids(texts[k : k + 250])]
    assert got == [e.ids for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_with_marks_are_not_encoded_one_by_one(monkeypatch):
    alone = []
    w = P.Words(P.default_tokenizer())
    by_one = w._one_by_one
    monkeypatch.setattr(w, "_one_by_one", lambda chunks: (alone.extend(chunks), by_one(chunks)))
    w.ids(["évich antre### évich, qué*** leen*** antre.*** über### éé.&&&"])
    assert set(alone) == {"###", "***", ",", ".***", ".&&&"}


def test_words_are_learnt_in_small_letters(monkeypatch):
    learnt = []
    w = P.Words(P.default_tokenizer())
    learn = w.learn
    monkeypatch.setattr(w, "learn", lambda words: (learnt.extend(words), learn(words)))
    texts = ["Évich évich ÉVICH Évich! THONE", "thone, Thone x", "Élan élan İx ÀÞ"]
    assert w.folds
    want = [np.array(e.ids, np.uint32).tobytes() for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [w.ids([t])[0] for t in texts] == want
    assert sorted(learnt) == sorted({"évich", "thone", "x", "élan", "àþ"})


def test_generations_and_errors_leave_no_wrong_ids(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 5)
    w = P.Words(P.default_tokenizer())
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["The", "the!", "of", "Of", "12", "é", "a.", "über", "ÜBER***", "x1", "日本"]) for _ in range(6)) for _ in range(60)]
    one = w._one_by_one

    def fail(chunks):
        raise RuntimeError

    monkeypatch.setattr(w, "_one_by_one", fail)
    try:
        w.ids(["new?word other12 The"])
    except RuntimeError:
        pass
    monkeypatch.setattr(w, "_one_by_one", one)
    texts.append("new?word other12 The")
    assert [w.ids([t])[0] for t in texts] == [np.array(e.ids, np.uint32).tobytes() for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]
