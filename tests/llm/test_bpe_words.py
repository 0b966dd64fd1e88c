"""Words of plain letters are not cut by the pattern, and their ids are those of any other way."""

import public_tokenizers

from visitory.llm import bpe


def test_plain_letters_are_one_word(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, texts = bpe.WordBpe(path), ["Hello wide world", "hello's World2 x-y ünder don't", "", None, "hello hello", "a" * 100]
    cut = bpe.WordBpe(path)
    monkeypatch.setattr(cut, "_cut", cut._words.findall)
    assert plain.encode(texts) == cut.encode(texts)

    class Never:
        def findall(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(plain, "_words", Never())
    assert all(plain.encode(["unseen letters only zqxjk"]))


def test_words_of_known_chunks_are_not_joined_again(monkeypatch):
    """Letters with signs behind them are cut without the pattern, and only words that no chunk has shown are joined."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, plain = bpe.WordBpe(path), bpe.WordBpe(path)
    monkeypatch.setattr(plain, "_cut", plain._words.findall)
    odd = ["jagañ, ciÓn!!", "dogs' it's 'll don't, '' '! !'s a.b x-", "ªº µ. ß?", "ǆ! слово, слово", "a\u0301, e_ _e 1, a1", "b" * 41 + "!", "b" * 50]
    assert coder.encode(odd) == plain.encode(odd)
    joined = []
    short = coder._short
    monkeypatch.setattr(coder, "_short", lambda words: joined.extend(words) or short(words))
    first = coder.encode(["unseenzq words"])
    assert coder.encode(["unseenzq, words, words."]) == plain.encode(["unseenzq, words, words."])
    assert first == plain.encode(["unseenzq words"])
    assert joined.count(b"unseenzq") == 1 and joined.count(b"words") == 1


def test_first_ranks_equal_the_searched_ones():
    """Words of one and of several bytes, side by side in all lengths."""
    coder = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    words = [bytes((7 * i + 13 * k) % 256 for k in range(i % bpe.SHORT + 1)) for i in range(300)] + [b"x", b"the", b"thing"]
    assert coder._short(words) == [coder._long(w) for w in words]
