"""Small tables with the awkward cases, and plain forms of what operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, node string, size string, key string, label string, score string, _text string"


def docs(spark, rows):
    """Documents from (doc_id, text[, source]); the other columns clash with names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", "y", "z", None, "w", None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeäé") for _ in range(r.randint(1, 7))) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, empty, white and very long texts, repeated rows."""
    base, passage, long = prose(1, 200), prose(2, 60), prose(3, 30_000)
    near = base.split()
    near[100] = "changed"
    rows = [
        (10, base),
        (3, base),
        (7, base.upper() if False else base),
        (8, " ".join(near)),
        (20, prose(4, 50) + " " + passage + " " + prose(5, 40)),
        (21, prose(6, 30) + "\n" + passage + "\t" + prose(7, 70)),
        (22, passage),
        (30, None),
        (31, ""),
        (32, " \n\t "),
        (33, "one two three"),
        (34, "one two three"),
        (40, long),
        (41, long + " tail"),
        (50, "word " * 300),
        (51, prose(8, 120)),
        (51, prose(8, 120)),
        (None, prose(9, 80)),
        (None, base),
        (60, "ÄÖ 世界 👍 " + prose(10, 20)),
    ]
    rows += [(100 + i, prose(100 + i, 40)) for i in range(30)]
    return rows


def collected(df, key="doc_id"):
    """Rows by doc_id; rows that share one are listed in order."""
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out
