"""Small awkward tables and plain forms of the operators."""

import os

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x string, key string, `_id` string, `a.b` int"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    base = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, base, "en", "s0"),
        (2, base.replace(" ", "\n\t"), "en", "s0"),
        (3, base + " tail", None, "s1"),
        (4, base.replace("word7 ", "other "), "de", None),
        (5, None, None, None),
        (6, "", "en", "s0"),
        (7, "  \n ", "en", "s0"),
        (8, long, "en", "s0"),
        (8, long, "en", "s0"),
        (None, "nobody knows this one", "fr", "s2"),
        (None, None, None, None),
        (9, "I'll say 'tis <|endoftext|> fine\r\n\r\n  ok \u3000x\x85é中1²🙂", "fr", "s2"),
        (10, "zwei drei", "de", "s2"),
        (11, "zwei drei", "de", "s2"),
        (12, "12345 !!!", "de", "s2"),
        (-3, "a" * 50_000, "en", "s0"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", None, "id", 5) for i, t, lang, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def kept_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def shingles(text):
    """Distinct five-word shingles of a text, by the plain definition."""
    up = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = (text or "").translate(up).encode().split()
    if len(words) < 5:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def groups_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def have(path):
    return os.path.exists(path)
