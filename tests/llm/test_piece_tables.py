"""Words of a batch fill their prefix tables together; results are those of the library, text by text."""

import hashlib
import random

import sentencepiece
from burnish.llm import sentencepiece_bpe
from burnish.llm.queries import piece_model


def odd_texts(n):
    pick = random.Random(5)
    parts = ["the", "of", "ción", "ß", "\n", "日本", "▁", "🙂", "\x00", "  ", " ", "Ab", "9", "##", "é", "é", "x" * 70, "\t", "unggesch"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(40))) for _ in range(n)]
    return [None, "", " ", "   ", "a", "\n", "\n\n a\n", *texts, "日本語" * 300, " " * 99 + "end"]


def wanted(sp, text):
    ids = sp.encode(text or "")
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), sp.decode(ids)))


def test_batches_agree_with_the_library(monkeypatch):
    data = piece_model()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = odd_texts(400)
    want = [wanted(sp, t) for t in texts]
    model = sentencepiece_bpe.PieceModel(data)
    assert model.digests(texts) == want
    assert model.digests([]) == []
    # small bounds: many slices, tables and generations of remembered words, pairs forgotten on the way
    for name, value in (("CACHE_WORDS", 50), ("KNOWN_PAIRS", 100), ("TEXT_CHARS", 200), ("TABLE_WORDS", 7), ("TABLE_CHARS", 20)):
        monkeypatch.setattr(sentencepiece_bpe, name, value)
    model = sentencepiece_bpe.PieceModel(data)
    assert model.digests(texts) == want
    assert all(len(s) <= 20 for held in (model._recent, model._older) for s in held[0])


def test_new_words_take_steps_by_length_not_by_number(monkeypatch):
    pick = random.Random(7)
    words = ["".join(pick.choice("aeioulnrstdmé\n") for _ in range(12)) for _ in range(3000)]
    model = sentencepiece_bpe.PieceModel(piece_model())
    steps, alone = [], []
    monkeypatch.setattr(model, "_next", lambda keys, own=model._next: steps.append(len(keys)) or own(keys))
    monkeypatch.setattr(model, "_stretch", lambda text: alone.append(text))
    model.digests([" ".join(words)])
    assert not alone and len(steps) <= sentencepiece_bpe.TABLE_CHARS


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "CACHE_WORDS", 100)
    monkeypatch.setattr(sentencepiece_bpe, "TEXT_CHARS", 300)
    model = sentencepiece_bpe.PieceModel(piece_model())
    model.digests([f"often w{i} x{i}" for i in range(3000)])
    assert len(model._recent[0]) + len(model._older[0]) < 400
    assert "▁often" in model._recent[0]
