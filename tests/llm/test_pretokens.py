"""The fast pre-token patterns against the tokenizers' own."""

from __future__ import annotations

import regex
from hypothesis import given, settings, strategies as st

from usagelens.llm import tokenizers_memo as memo

SURE = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not memo.UNSURE.match(chr(c)))
PIECES = st.one_of(st.sampled_from(list(SURE[:600])), st.sampled_from(list(SURE)), st.sampled_from(["'s", "'ll", " 've", "  ", "\n ", "\x1c", "\x85", "12"]))
PATTERNS = [(memo.fast(memo.FAST_WORD), regex.compile(memo.WORD_PATTERN)), (memo.fast(memo.FAST_BYTE), regex.compile(memo.BYTE_PATTERN))]


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_equal_pretokens(text):
    for fast, own in PATTERNS:
        assert fast.findall(text) == own.findall(text)
        assert fast.findall(text.lower()) == own.findall(text.lower())
