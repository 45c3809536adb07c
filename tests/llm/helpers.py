"""Small document tables and plain-Python versions of what the operators compute."""

from __future__ import annotations

import glob

import pandas as pd
import xxhash

SF_DIR = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASHING = "id long, locator long, document string, digest string, fingerprint long, component_id long, place long, n long, row long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def frame(spark, rows):
    """Documents of (doc_id, text[, lang]) with further columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 1, 2, "x", "y", 3, 4, 5, 6, 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def documents() -> pd.DataFrame:
    return pd.concat([pd.read_parquet(f) for f in glob.glob(f"{SF_DIR}/documents.parquet*")])


def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "lorem ipsum dolor sit amet consectetur " * 3000
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, long), (7, long + "end"), (8, "a b  c"), (8, "a b  c"), (9, "a b\tc"),
        (None, "a b c"), (10, "été 日本語 \U0001f600"), (11, "1234 5678 ..."), (12, "a" * 5000), (13, "one", None),
    ]


def simhash(text, size):
    words = [w.encode() for w in _split(text)]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    return words


def components(values, most_bits):
    """Smallest position reachable for each value, by comparing all."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most_bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]
