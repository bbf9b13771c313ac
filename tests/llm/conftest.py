import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tag string, line bigint, part int, words string, `key` string, score double, budget int"


def make_rows(seed: int = 1) -> list[tuple]:
    """Copies, near copies, repeated passages and lines, nulls, empty and long texts, repeated rows and ids."""
    r = random.Random(seed)
    vocabulary = {lang: ["".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(300)] for lang, s in {"en": ("th", "er", "on", "an"), "de": ("sch", "ung", "ei", "ß"), "fr": ("eau", "é", "ou", "ç"), "es": ("ción", "ñ", "os", "ar")}.items()}
    prose = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    passage, line = prose("en", 70), prose("en", 9)
    texts = []
    for i in range(60):
        lang = ("en", "de", "fr", "es")[i % 4]
        texts.append((lang, "\n".join([line] * (i % 3 == 0) + [prose(lang, r.randint(5, 60)) for _ in range(r.randint(1, 5))])))
    copy = max(texts[:12], key=lambda t: len(t[1]))
    texts += [copy, copy, ("en", copy[1] + " one"), ("en", prose("en", 20) + " " + passage + " " + prose("en", 20)), ("en", passage + "\n" + prose("en", 30))]
    words = texts[8][1].split(" ")
    words[len(words) // 2] = "edited"
    texts += [("en", " ".join(words)), ("en", None), (None, ""), (None, " \n\t "), ("de", "x"), ("en", "123 456"), ("en", "a b\u00a0c  d\x1ce"), ("fr", "mot " * 400), ("en", prose("en", 30_000))]
    rows = [(i, text, lang, f"src{i % 5}" if i % 7 else None, len(text or ""), "t", i, 0, "w", "k", 0.5, 1) for i, (lang, text) in enumerate(texts)]
    return rows + [rows[5], rows[5], (6, "another text with the same id", "en", "src1", 29, *rows[0][5:]), (None, copy[1], "en", "src0", 1, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique(spark, rows):
    """Rows with an id of their own each."""
    seen = {}
    for row in rows:
        if row[0] is not None:
            seen.setdefault(row[0], row)
    return list(seen.values())


@pytest.fixture(scope="session")
def unique_docs(spark, unique):
    return spark.createDataFrame(unique, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
