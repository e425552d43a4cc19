import public_tokenizers

from cohortlens.llm.tokens import LONGEST, Encoder


def test_long_words_are_encoded_but_not_remembered():
    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join("ab" * (LONGEST + k) + "," for k in range(20)) + " short words"
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert enc.ids(text).tolist() == enc.ids(text).tolist() == want
    assert max(map(len, [*enc.words, *enc.pieces])) <= LONGEST and b"short" in enc.words
