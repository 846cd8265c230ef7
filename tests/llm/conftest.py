import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(chance, n, words=400):
    return " ".join("".join(chance.choices("abcdeé", k=chance.randint(1, 4))) + chance.choice(["", "", "", ".", ",", "!"]) for _ in range(n)) if n else ""


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, blanks, nulls, a long text, and odd white space."""
    chance = random.Random(seed)
    passage = prose(chance, 40)
    texts = [prose(chance, chance.choice([3, 12, 30, 80, 200])) for _ in range(n)]
    texts += [texts[i] for i in range(0, n, 6)] + [texts[4]] * 5
    for i in range(0, n, 5):
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(chance, 15)} {passage} {prose(chance, 9)}" for _ in range(6)]
    texts += ["", " \n\t ", None, None, "one", "The the THE", "x\x0by\x0cz\r\nw", "a b c", "日本 語 ünïcode <|endoftext|> it's WE'LL", prose(chance, 6000), "loop " * 120, "a  b   c    d\n\n\ne"]
    order = list(range(len(texts)))
    chance.shuffle(order)
    return [(i, texts[k], "en", "src0", len(texts[k] or "")) for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark, docs_rows):
    """Null ids, repeated rows and repeated ids, with columns whose names clash with the operators' own."""
    rows = [*docs_rows[:30], *docs_rows[:3], (None, docs_rows[5][1], None, None, None), (None, None, None, None, None), (7, "another text of this id", "en", None, 1)]
    clash = ["kind", "row", "score", "token", "cls", "n", "part", "a", "b", "doc", "spans", "salt", "text_key", "component", "held", "node"]
    return spark.createDataFrame([(*r, *clash) for r in rows], f"{SCHEMA}, " + ", ".join(f"{c} string" for c in clash)), rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
