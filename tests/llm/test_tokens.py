import random
import struct

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sievemill.llm import textbuf, tokens

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = ["the", "The", "don't", "I'll", "'s", "é", "É", "é", "Σίσυφος", "ΟΔΟΣ", "İ", "ß", "漢字", "١٢", "12", "½", " ", "  ", "\n", "\r\n", "\t", " ", " ", "　", "\x1c", "\x85", "​", "́", "̸", ".", ",", "!", "?!", "...", ";", "=", "<", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "a.", "b,", "x!̸", "5.", "_", "-", "\u0958", "\u0958.", "\U0001f600", "\x00"]


@pytest.mark.parametrize("name", NAMES)
def test_ids_are_those_of_whole_texts(name):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(6000)] + ["", None, "w" * 5000]
    encoder = tokens.Encoder(tokens.tokenizer_path(name))
    plain = Tokenizer.from_file(tokens.tokenizer_path(name))
    for lo in (0, 3000):
        part = texts[lo : lo + 3003]
        want = [e.ids for e in plain.encode_batch([t or "" for t in part], add_special_tokens=False)]
        got = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encoder.ids(part)]
        flat, first = encoder.batch(textbuf.Texts(pa.array(part, pa.string())))
        assert [flat[a:z].tolist() for a, z in zip(first, first[1:], strict=False)] == want
        bad = [(t, a, b) for t, a, b in zip(part, want, got, strict=True) if a != b]
        assert not bad, (len(bad), bad[:3])


@pytest.mark.parametrize("name", NAMES)
def test_words_by_the_thousand(name):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    texts = [" ".join(rng.choice(words).title() if rng.random() < 0.3 else rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(400)) for _ in range(40)]
    encoder = tokens.Encoder(tokens.tokenizer_path(name))
    want = [e.ids for e in Tokenizer.from_file(tokens.tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encoder.ids(texts)] == want


def test_strings_of_added_tokens_have_their_ids():
    for name, ids in {"word_bpe_49k.json": [320, 49407, 321], "byte_bpe_50k.json": [64, 220, 50256, 275]}.items():
        encoder = tokens.Encoder(tokens.tokenizer_path(name))
        flat, first = encoder.batch(textbuf.Texts(pa.array(["x", "a <|endoftext|> b", "y"])))
        assert flat[first[1] : first[2]].tolist() == ids
        assert encoder.ids(["a <|endoftext|> b"])[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_other_vocabularies(tmp_path):
    """Files of any name, and tokenizers whose chunks aren't known, which get whole texts."""
    import json
    import shutil

    at = shutil.copy(tokens.tokenizer_path("byte_bpe_50k.json"), tmp_path / "own.json")
    assert tokens.Encoder(str(at)).kind == "bytes"
    spec = json.loads(at.read_text())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    at.write_text(json.dumps(spec))
    encoder, plain = tokens.Encoder(str(at)), Tokenizer.from_file(str(at))
    texts = ["one two", "", "two  three\n", "<|endoftext|> é"]
    flat, first = encoder.batch(textbuf.Texts(pa.array(texts)))
    assert encoder.kind is None
    assert [flat[a:z].tolist() for a, z in zip(first, first[1:], strict=False)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
