import random

import numpy as np
from tokenizers import Tokenizer

from sparknorm.llm import tokens as tk
from sparknorm.llm.shingles import word_hashes


def test_ids_equal_the_librarys():
    library = Tokenizer.from_file(tk.default_vocabulary())
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", "\n\n", "a", "The land", "über", "漢字", "x.", ", ", "it's", "12 3", "\u00a0", "…"]
    texts = ["", "<|endoftext|>", "", *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)), *("".join(rng.choices(parts[1:], k=20)) for _ in range(200))]
    for these in (texts, texts[:2], texts[1:2], texts[-100:], []):
        ids, ends = tk.encoder(tk.default_vocabulary()).encode(these)
        assert len(ends) == len(these)
        start = 0
        for t, end in zip(these, ends.tolist(), strict=True):
            assert ids[start:end].tolist() == library.encode(t, add_special_tokens=False).ids
            start = end
        assert start == len(ids)
    assert 50256 in tk.encoder(tk.default_vocabulary()).encode(["a<|endoftext|>b"])[0]


def thue_morse(n):
    s = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_strings_that_clash_under_polynomial_hashes():
    library = Tokenizer.from_file(tk.default_vocabulary())
    for n in (8, 16, 24, 32, 64, 256, 1024, 4096):
        a, b = thue_morse(n)
        texts = [a, b, f"{a} {b}", f"{b} {a}"]
        assert len(set(word_hashes([a, b])[0].tolist())) == 2
        ids, ends = tk.ChunkEncoder(tk.default_vocabulary()).encode(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_table_starts_anew():
    library = Tokenizer.from_file(tk.default_vocabulary())
    rng = random.Random(5)
    small = tk.ChunkEncoder(tk.default_vocabulary(), slot_bits=4)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 30))) for _ in range(20)) for _ in range(3)] + ["a\0", "a", "a\0\0"]
        ids, ends = small.encode(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_every_length():
    rng = random.Random(1)
    texts = ["", " ", *(" ".join("".join(rng.choices("aBcé", k=rng.choice([1, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(9)) for _ in range(50))]
    hashes, count = word_hashes(texts)
    words = [w.translate(str.maketrans("B", "b")) for t in texts for w in t.split()]
    assert count.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist(), strict=True)))
