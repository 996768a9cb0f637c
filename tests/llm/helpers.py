import random


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    vocab = [word() for _ in range(150)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randint(0, 5)
                w += p[a : len(p) - rng.randint(0, 5)]
            if rng.random() < 0.1:
                w += [rng.choice(vocab)] * 70
        docs.append((i * 3 + 5, rng.choice([" ", "\n", "  "]).join(w)))
    docs += [(1000, docs[3][1]), (1001, ""), (1002, None), (1003, docs[3][1] + " x"), (1004, "a\tb\x0bc")]
    rng.shuffle(docs)
    return docs
