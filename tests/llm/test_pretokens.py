import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.pretokens import encode_texts
from tessera.llm.tokenfiles import byte_bpe, tokenizer_path


def test_random_texts_encode_like_the_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    bits = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", " ", "　", "a", "the", "Été", "12", "³", "!", "?!", "漢字", "🙂", "<|endoftext|>", "'S", "s", "d", "\u0085", "\x1c", "'ve", "'r", "e"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(3000)] + ["", "'", "'s", " ", "\n ", "don't 've", "x" * 5000, "see <|endoftext|> here", "<|endoftext|>", "<|endoftext|"]
    data = [x.encode() for x in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in data])))
    ids, counts = encode_texts(byte_bpe(tokenizer_path()), np.frombuffer(b"".join(data), np.uint8), offsets, 2)
    at = np.concatenate(([0], np.cumsum(counts)))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids + [2], repr(text)
