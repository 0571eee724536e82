"""New words are encoded many in a call."""

import numpy as np
from public_tokenizers import path as tokenizer_path

from tallyloom.llm import token_files as tf

BPE = tokenizer_path("byte_bpe_50k.json")


class Counted:
    """A tokenizer that counts its calls."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.calls = tokenizer, 0

    def encode_batch_fast(self, texts, add_special_tokens):
        self.calls += 1
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_words_of_a_text_are_encoded_together():
    words = [f"w{i}é-{i * 7}語" for i in range(3000)] + ["<|endoftext|>", "a<|endoftext|>b", "don't", "x\ny"]
    texts = [" ".join(words), " ".join(words[::-1]), "a  b \n c  ", "", " lone "]
    encode = tf.Encoder(BPE, 4)
    whole = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encode.tokenizer = Counted(encode.tokenizer)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encode.several(texts)] == whole
    assert encode.tokenizer.calls < 20
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == whole


def test_ids_of_unknown_length_are_found_word_by_word():
    texts = ["some words of a text", "other words here"]
    encode = tf.Encoder(BPE, 2)
    want = [encode(t) for t in texts]
    other = tf.Encoder(BPE, 2)
    other.sizes = other.sizes + (np.arange(len(other.sizes)) % 2)
    assert other.several(texts) == want


def test_a_word_of_many_texts_is_looked_up_once():
    texts = ["one two three two", "", "  two\n three  one ", "three one two"] * 50
    encode, asked = tf.Encoder(BPE, 4), []
    encode.words.get = lambda word: asked.append(word) or dict.get(encode.words, word)
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encode.several(texts)] == want
    assert len(asked) == len(set(asked))
