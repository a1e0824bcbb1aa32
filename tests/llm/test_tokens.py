"""Token ids against the library, over all of Unicode."""

import random

import numpy as np

from tessella.llm import quality
from tessella.llm.common import powers
from tessella.llm.tokens import Encoder


def test_every_code_point_has_the_librarys_ids():
    e = Encoder()
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("{} ", "a{}B ", "1 {}'s\x0b", "Σ{}́\n"):
        for at in range(0, len(points), 512):
            text = "".join(map(form.format, points[at : at + 512]))
            want = e.tokenizer.encode(text, add_special_tokens=False).ids
            assert e.ids(text).tolist() == want, (form, hex(at))


def test_mixed_texts_have_the_librarys_ids():
    rng, e = random.Random(5), Encoder()
    signs = [*"aZéß'09 \t\n\r\x0b\x0c\x1c\x85\xa0 　", "́", "İ", "Σ", "ǅ", "ﬁ", "한", "가", "漢", "👍🏽", "՘", "\U00010940", "<|", "|>", "endoftext", "<|endoftext|>"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(4000)]
    assert [x.tolist() for x in e.batch(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_word_positions_count_without_bound():
    at = np.array([0, 4095, 4096, 8191, 8192, (1 << 24) + 4096 + 5])
    m = 0x9E3779B97F4A7C15
    assert powers(at).tolist() == [pow(m, int(a) + 1, 1 << 64) for a in at]
    word = "x" * 5000
    assert set(quality.features(word + "ab").tolist()) != set(quality.features(word + "ba").tolist())
