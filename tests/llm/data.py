"""Small corpora with the hard cases: nulls, empty texts, ties, copies, shared passages, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _id int, key string, count int, size int"


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(seed=1, docs=60):
    """Rows of SCHEMA: random texts, exact and near copies, passages in several texts, short, empty and null ones."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    texts = []
    for i in range(docs):
        text = sentence(rng, rng.randint(30, 200))
        if i % 4 == 0:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        texts.append(text)
    texts += texts[:10] + texts[:5]
    for i in range(20, 40):
        words = texts[i].split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["", None, None, "", "one", "two words", "  \n\t ", "a a a a a a a a", "x" * 500, "é" * 120 + passage, passage, passage + "!", "ab" * 300, "\x00" * 150]
    rng.shuffle(texts)
    return [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", 0, "r", 1, "k", 2, 3) for i, t in enumerate(texts)]
