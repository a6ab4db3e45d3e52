"""The encoder remembers a bounded number of units, each once, whatever the texts hold."""

import random
import string

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cohortwise.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def entries(memo):
    return len(memo) + len(memo._old)


def test_few_units_are_remembered_and_the_ids_stay():
    dice, encode = random.Random(5), packing.UnitEncoder(PATH, 1000)
    words = ["".join(dice.choices(string.ascii_letters + "éß", k=dice.randint(3, 9))) for _ in range(20_000)]
    words = [w + dice.choice(["", "", ",", ".", "-x", "'s", "7"]) for w in words]
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + ["", " ", "a  b, c", "word, word word. word"]
    found = []
    for text in texts:
        found += encode([text])
        assert entries(encode._spaced) <= 2 * 1050 and entries(encode._piece) <= 2 * 350
    expected = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [x.ids for x in expected]


def test_a_plain_word_is_held_once():
    encode = packing.UnitEncoder(PATH)
    list(encode(["one two three"]))
    assert "three" in encode._spaced and " three" not in encode._piece


def test_the_pipeline_remembers_less(monkeypatch):
    asked = {}
    monkeypatch.setattr(packing, "pack", lambda *_, **named: asked.update(named))
    corpus_pipeline.packing_stage(None, None, "")
    assert asked["remembered"] <= 100_000
