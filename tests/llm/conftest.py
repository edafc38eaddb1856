"""Small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, position double, kept string, size long"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def make_rows(seed=1, n=60):
    rng = random.Random(seed)
    en = "the of and stream river walking houses brightly weather".split()
    de = "der die und schule straße häuser morgen größer wetter".split()
    rows = []
    for i in range(n):
        lang, words = ("en", en) if i % 3 else ("de", de)
        own = [rng.choice(words) + rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(40)]
        text = "\n".join(sentence(rng, rng.randint(3, 25), words + own) for _ in range(rng.randint(1, 6)))
        rows.append((i, text, lang, rng.choice(["src1", "src10", "src2", None])))
    passage = sentence(rng, 120, en + de)
    base = rows[5][1].split(" ")
    for k, i in enumerate(range(n, n + 6)):  # near copies
        w = list(base)
        w[(7 * k) % len(w)] = f"changed{k}"
        rows.append((i, " ".join(w), "de", "src1"))
    rows += [(n + 10 + k, f"{sentence(rng, 9, en)} {passage} {sentence(rng, 9, en)}", "en", "src2") for k in range(4)]
    rows += [(n + 20, None, None, None), (n + 21, "", "en", "src1"), (n + 22, "123 456 !! ½ Ⅳ ²", None, "src1"), (n + 23, "  \t\n ", "en", "src2")]
    longest = max(rows[:n], key=lambda r: len(r[1]))[1]
    rows += [(n + 24, longest, "en", "src1"), (n + 25, longest, "en", "src1"), rows[4], rows[4], (None, rows[6][1], "en", "src1"), (None, None, None, None)]
    rows += [(n + 30, sentence(rng, 9000, en), "en", "src10"), (n + 31, "x" * 3000, "en", "src1"), (n + 32, "İSTANBUL Σίσυφος ﬁ é é <|endoftext|> ▁x 日本 \U0001f600 it's 2024", None, "src2")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", 0.5, "no", 1) for i, t, la, s in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
