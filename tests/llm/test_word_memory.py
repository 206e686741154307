"""The numbers of words that a worker keeps stay few, and sets don't depend on when they begin anew."""

from alnspark.llm import minhash


def test_words_begin_anew_early(monkeypatch):
    monkeypatch.setattr(minhash, "WORDS", minhash.Words())
    texts = [[[b"w%d" % (k * 1000 + i) for i in range(1000)]] for k in range(300)]
    first = [minhash.shingles(t, 5)[1][0].tolist() for t in texts]
    assert len(minhash.WORDS) <= 150_000
    monkeypatch.setattr(minhash, "WORDS", minhash.Words())
    monkeypatch.setattr(minhash.Words, "LIMIT", 10**6)
    assert first == [minhash.shingles(t, 5)[1][0].tolist() for t in texts]
