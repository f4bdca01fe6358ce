import numpy as np

from archivist.functions import embed


def test_batches_embed_as_single_texts(monkeypatch):
    texts = ["", None, "ÀÉ a_b-c -- _ x", "   ", *(f"Brand#{k % 5}\n{k}\nPROMO {k % 3} né-{k}" for k in range(30))]
    alone = np.stack([embed.embed(t) for t in texts])
    monkeypatch.setattr(embed, "ROWS", 7)
    sizes = []
    real = embed.fnv1a
    monkeypatch.setattr(embed, "fnv1a", lambda tokens, seed: sizes.append(len(tokens)) or real(tokens, seed))
    assert np.array_equal(embed.embed_all(texts), alone)
    assert max(sizes) < len(set().union(*map(embed.features, (t or "" for t in texts))))  # no batch is held whole
