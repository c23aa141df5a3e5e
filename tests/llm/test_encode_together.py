"""New words of a group are encoded in few calls, and each keeps its own ids."""

import public_tokenizers

from vigilday.llm import packing


def test_new_words_in_few_calls():
    own = packing.Encoder(public_tokenizers.path(packing.MODEL))
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(20_000)]
    calls, bare = [], own.bare

    class Counting:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return bare.encode_batch_fast(texts, **options)

    own.bare = Counting()
    found = own.together(words)
    assert len(calls) == 1 and found[::977] == own.each(words[::977])


def texts_and_calls(own, texts):
    """The ids of texts looked up one after the other, and how many words were encoded."""
    words, run = [], own.parts.encode
    own.parts.encode = lambda new: (words.extend(new), run(new))[1]
    return [own.ids(t) for t in texts], len(words)


def test_words_seen_once_are_not_encoded_again():
    own = packing.Encoder(public_tokenizers.path(packing.MODEL))
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(5_000)]
    texts = [" ".join(words), " ".join(reversed(words)), " ".join(words[::2]) + " "]
    found, encoded = texts_and_calls(own, texts)
    assert encoded == len(words)
    assert found == [own.encode(t).tobytes() for t in texts]


def test_dropped_words_keep_their_ids(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 300)
    monkeypatch.setattr(packing, "KEPT_IDS", 500)
    own = packing.Encoder(public_tokenizers.path(packing.MODEL))
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(1_000)] + ["x" * 80, "été"]
    texts = [" ".join(words[i : i + 90] + words[:30]) for i in range(0, 1_002, 70)] + [" ", "", "...", "x" * 80]
    found, _ = texts_and_calls(own, texts)
    assert found == [own.encode(t).tobytes() for t in texts]
    kept = own.parts.known.to_pylist()
    assert len(kept) <= 300 and own.parts.sizes.sum() == len(own.parts.ids) <= 500 and "x" * 80 not in kept
    # the words of every text are used most
    assert set(words[:30]) <= set(kept)
