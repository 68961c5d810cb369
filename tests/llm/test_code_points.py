"""Every code point, and mixtures of rare ones, as the library encodes them."""

import random

from tokenizers import Tokenizer

from skein.llm import bpe
from skein.llm.common import vocabulary


def test_all_code_points_equal_the_library():
    path = vocabulary("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), bpe.PrefixEncoder(path)
    library.no_truncation()
    library.no_padding()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(1)
    some = [rng.choice(points) for _ in range(3000)] + list("abc ABC 012 .,'sİΣςσ̧́ͅ") * 20
    mixed = ["".join(rng.choice(some) for _ in range(rng.randint(1, 12))) for _ in range(20000)]
    for texts in (["a" + c + "a" for c in points], ["İ" + c for c in points], ["Σ" + c + "Σ" for c in points[:0x3000]], mixed):
        for at in range(0, len(texts), 50000):
            part = texts[at : at + 50000]
            for x, want in zip(part, library.encode_batch(part, add_special_tokens=False)):
                assert mine.encode(x) == want.ids, ascii(x)
