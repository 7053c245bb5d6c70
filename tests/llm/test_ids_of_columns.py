"""Op 4: a column's texts are cut in their bytes, and each distinct cut is encoded once."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from colloquy.llm import huffman, tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", " ", "\n", "\n\n", ".\n", " \n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", " ", "　", "​", "a", "the", "Word", "é", "ß", "×", "÷", "ř", "ʼ", "α", "ж", "ع", "́", "中", "한", "😀",
          "'", "'s", "'ll", "'st", ".", ",", "%%%", "-", "1", "23", "½", "٣", "<|endoftext|>", "<|", "\x00", "\x7f", "”", "…", " à ", "x" * 60]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_of_a_column_equal_the_library(seed):
    plain, use, pick = tokenizers.Tokenizer.from_file(JSON), tokens.Encoder(JSON), random.Random(seed)
    end = np.array([2], use.width).tobytes()
    texts = [None, "", *("".join(pick.choices(PIECES, k=pick.randint(0, 12))) for _ in range(3000)), "", None]
    for own in (texts, texts[1:2], texts[-1:], texts[:40]):
        got = use.column(pa.array(["before ", None, *own], pa.string()).slice(2), end)
        assert [np.frombuffer(ids, use.width).tolist() for ids in got.to_pylist()] == [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in own]
    assert len(use.column(pa.array([], pa.string()), end)) == 0


def test_each_distinct_cut_is_encoded_once(monkeypatch):
    use, made = tokens.Encoder(JSON), []
    part = use._part
    monkeypatch.setattr(use, "_part", lambda cut: made.append(cut) or part(cut))
    column = pa.array(["Wide words, wide words.\nWide é words à words"] * 50)
    first = use.column(column)
    assert sorted(made) == sorted({"Wide", " words", ",", " wide", ".", "\n", " é", " à"})
    assert use.column(column) == first and len(made) == 8       # remembered


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "PARTS", 2000)
    plain, use = tokenizers.Tokenizer.from_file(JSON), tokens.Encoder(JSON)
    for k in range(40):
        texts = [f"word{k * 20 + i} again{'y' * i * 5}" for i in range(20)]
        assert [np.frombuffer(ids, use.width).tolist() for ids in use.column(pa.array(texts)).to_pylist()] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert use.parts.nbytes + use.part_ids.nbytes < 2 * 2000 and len(use.parts) == len(use.part_ids)


def test_groups_of_whole_rows():
    assert huffman._groups(np.array([3, 3, 9, 1, 0, 30]), 5) == [(0, 1), (1, 2), (2, 5), (5, 6)]
    assert huffman._groups(np.array([], np.int64), 5) == []
