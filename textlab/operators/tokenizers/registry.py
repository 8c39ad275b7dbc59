"""Tokenizers by name, one interface: ``train(words_df, vocab_size) -> vocab_df`` and
``encode(df, col, vocab_df, out) -> df``."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable


@dataclass(frozen=True)
class Tokenizer:
    name: str
    train: Callable
    encode: Callable


def get(name: str) -> Tokenizer:
    key = name.lower()
    if key == "word":
        from textlab.operators.tokenizers import word as m
        return Tokenizer("word", m.train_word_vocab, m.encode_word)
    if key == "char":
        from textlab.operators.tokenizers import char as m
        return Tokenizer("char", m.train_char_vocab, m.encode_char)
    if key == "bpe":
        from textlab.operators.tokenizers import bpe as m
        return Tokenizer("bpe", m.train_bpe, m.encode_bpe)
    if key == "unigram":
        from textlab.operators.tokenizers import unigram as m
        return Tokenizer("unigram", m.train_unigram, m.encode_unigram)
    raise KeyError(f"unknown tokenizer {name!r}; choose word, char, bpe or unigram")


NAMES = ("bpe", "word", "char", "unigram")
