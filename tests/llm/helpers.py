"""Small documents for the edge cases that every operator must define: nulls, empty and long texts, repeats, ties."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, token string, row string, score double, node long"


def prose(rng: random.Random, n: int, words: str) -> str:
    return " ".join(rng.choice(words.split()) for _ in range(n))


EN = "the of and to in house river stone light garden winter morning letter window story bridge market silver"
FR = "le la les de des maison rivière pierre lumière jardin hiver matin lettre fenêtre histoire pont marché été"


def edge_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(60, 200), EN if i % 2 else FR) for i in range(40)]
    base = prose(rng, 120, EN).split()
    for k in range(6):  # near copies, linked to the base or along a chain
        own = list(base)
        for j in range(k):
            own[10 + 15 * j] = f"changed{j}"
        texts.append(" ".join(own))
    texts += ["", "   \n\t ", "one", "one two three", None, None, texts[0], texts[0], texts[0].upper(), "x" * 30000, prose(rng, 12000, EN), "12 34 !!", "a\x0bb\x0cc\rd e f"]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), 7, "tok", "row", 0.5, 3) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "null id " + texts[3], None, None, None, None, None, None, None, None), (3, "another version of three " + texts[7], None, None, None, None, None, None, None, None)]


def edge_docs(spark, seed: int = 1):
    return spark.createDataFrame(edge_rows(seed), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
