"""Documents with everything that may go wrong, and brute-force helpers."""

import re

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
TEXTS = {
    1: "The quick brown fox jumps over the lazy dog, again and again.\nA second line.",
    2: None,
    3: "",
    4: " \t\n ",
    5: "one",
    6: "one two",
    7: "Ünïcode wörds – “quoted”, don't stop; 12 x 3.5!\tTab\r\nline  two  spaces ",
    8: LONG,
    9: "The quick brown fox jumps over the lazy dog, again and again.\nA second line.",
    10: "the the the the the",
    11: "<|endoftext|> A\n\n\nB \n C  D\n",
}
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, key string, fingerprint int,"
    " score string, selected int, rank int, c0 int, c1 string, _key int, _text string, node int, kind string, n_tokens int, `odd name.x` int"
)


def row(i, text):
    clash = (7, "k", 1, "s", 2, 3, 4, "c", 5, "t", 6, None, 8, 9)
    return (i, text, None if i == 3 else "en", "src0", None if text is None else len(text), *clash)


def documents(spark):
    """All texts, one row twice, one id with two texts, and null ids."""
    rows = [row(i, t) for i, t in TEXTS.items()] + [row(1, TEXTS[1]), row(5, "another text"), row(None, "no id"), row(None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int, text string")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def groups(links, nodes):
    """Smallest node reachable from each."""
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        least[y] = x
    return {n: find(n) for n in nodes}
