import pytest


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, shared passages, periodic stretches, nulls and empties."""
    import random

    rnd = random.Random(7)
    words = ["ab", "c", "déjà", "the", "of", "x1", "lorem", "Ipsum", "zz", "q,"]
    passage = " ".join(rnd.choice(words) for _ in range(70))
    out = []
    for i in range(60):
        t = " ".join(rnd.choice(words) + ("\n" if rnd.random() < 0.1 else "") for _ in range(rnd.choice([0, 3, 40, 60, 200])))
        if i % 7 == 3:
            t = t + " " + passage + "\t" + t[:30]
        if i % 11 == 5 and out:
            t = out[-3]
        if i % 13 == 6:
            t = "ab " * 150 + t
        if i % 17 == 8:
            t = None
        out.append(t)
    return out
