import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))

EDGE_TEXTS = [None, "", " ", "   ", "a", "a\nb", "  lead and trail  ", "ünï cödé 日本語 🙂", "<|endoftext|> </s> <0x0A> ▁", "x" * 3000, "word " * 5000, "same text here", "same text here", "\n\n\n", "\x1c\x85\xa0z", "1 2.5 km"]


@pytest.fixture(scope="session")
def edge_texts():
    return EDGE_TEXTS


@pytest.fixture(scope="session")
def piece_model():
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def word_model():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
