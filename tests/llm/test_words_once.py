"""The tokenizer's model is asked once a word, and blocks are counted without a sort."""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from usagelens.llm import token_ids
from usagelens.llm.tokenizers_memo import TextEncoder

TEXTS = ["Two words, two  words\n\x00 and 12's we'll été жあ一", "two new words", "", "   "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_word_is_asked_once(name):
    made, asked = TextEncoder(public_tokenizers.path(name)), Counter()
    tokenize = made.parts.tokenize
    made.parts.tokenize = lambda part: asked.update([part]) or tokenize(part)
    for _ in range(2):
        for text, ids in zip(TEXTS, made.encode_many(TEXTS)):
            assert np.frombuffer(ids, "<u4").tolist() == made.whole.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(made.parts) > 9 and set(asked.values()) == {1}


def test_other_steps_of_a_pre_tokenizer_go_to_the_library(tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        spec = json.load(file)
    spec["pre_tokenizer"]["pretokenizers"].insert(1, {"type": "Split", "pattern": {"String": "r"}, "behavior": "Isolated", "invert": False})
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    made = TextEncoder(str(tmp_path / "other.json"))
    assert made.kind == "other"
    assert np.frombuffer(made.encode("words error"), "<u4").tolist() == made.whole.encode("words error", add_special_tokens=False).ids


def test_blocks_are_counted_without_a_sort(monkeypatch):
    monkeypatch.setattr(np, "unique", None)
    ids = [np.array(some, "<u4") for some in ([7, 7, 49405, 0, 1], [3, 7, 0, 1], [1])]
    block = token_ids._block(0, 0, 0, [1, 2, 3], ids)
    ranks = np.frombuffer(block["ranks"], "<u4")
    assert ranks.tolist() == [1, 7, 0, 3, 49405]
    assert ranks[token_ids.unpack(block["control"], block["data"], block["n_ids"])].tolist() == np.concatenate(ids).tolist()
