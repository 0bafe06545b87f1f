import random

import public_tokenizers

from palimpsest.llm import bpe


def test_words_as_the_library_on_odd_texts():
    """Contractions, numbers, marks, white space of all kinds, controls and runs about LONG, apart and mixed."""
    encoder = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    signs = [*"ab'stredvml,.;1²½\t\n\v\f\r\x85\xa0 éİ̇ß", "'re", "''ll", " 's", "  ", "\x1c", "\0", "中"]
    texts = ["".join(rng.choice(signs[: rng.choice((20, len(signs)))]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["x" * n + tail for n in (511, 512, 1023, 1024, 1025, 2000) for tail in ("", " a" * 800)]
    for text in texts:
        assert encoder.ids(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_short_words_by_blocks():
    """A run of more than LONG bytes is never short, wherever it lies; shorter ones are."""
    encoder = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    for n in (1, 511, 513, 1023, 1024, 1025, 1026, 1600):
        for lead in (0, 3, 511, 512, 700):
            data = b"a " * (lead // 2) + b"x" * n + b" " + b"a " * 600
            if n != bpe.LONG:  # may count as either
                assert encoder.short_words(data) == (n < bpe.LONG)
