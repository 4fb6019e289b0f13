"""Small documents with every awkward case, and plain-Python counterparts."""

import random
import re
import zlib

WORDS = "the of and to in is it for was with on are this that not stone river cloud lamp green seven walk paper early sound"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text) if text else []


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def prose(rng, n):
    vocabulary = WORDS.split()
    out = []
    for i in range(n):
        w = rng.choice(vocabulary)
        out.append(w + ("." if rng.random() < 0.08 else ""))
    return " ".join(out)


def documents(seed=3):
    """(doc_id, text, lang, source, n_chars) rows."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(i, prose(rng, rng.choice([60, 90, 200])), "en", rng.choice(["web", "books", "b", "Ü", None])) for i in range(20)]
    rows += [(100, base, "en", "web"), (101, base, "en", "books"), (102, " ".join(near), "en", "web"), (103, base.upper(), None, "web")]
    rows += [(200, None, "en", "web"), (201, "", "en", "web"), (202, " \n\t ", None, None), (203, "one", "en", "web"), (204, "one", "en", "web"), (205, "a b c", "de", "b")]
    rows += [(300, prose(rng, 20_000), "en", "books"), (301, "x" * 50_000, "en", "web"), (302, "Straße ÉCOLE 東京 ﬁn é ​ \x00 ▁x", "fr", "Ü")]
    rows += [rows[7], (None, prose(rng, 70), "en", "web"), (None, None, None, None), (400, "tok <|endoftext|> mid<|startoftext|>dle", "en", "web")]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, extra=True):
    """The rows as a DataFrame; with extra columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    if extra:
        for c in ("row", "word", "key", "size", "n_words", "kept", "_row", "item_id", "node", "part", "score"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def shingles(text, k):
    w = words(lower(text)) if text else []
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def components(sets):
    """Least id reachable, by all pairs of sets with similarity 0.8 or more."""
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}
