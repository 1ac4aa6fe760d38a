"""Small corpora for the operators' tests."""

import random
import re

SPACE = "[^\x20\x09-\x0d]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def words(text):
    return re.findall(SPACE, text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, f"s{i % 6}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def with_extra(docs):
    """The same rows with further columns whose names could clash."""
    from pyspark.sql import functions as F

    names = ("score", "size", "k", "hits", "pos", "line", "fp", "w", "n_words", "copies", "h", "rank", "__x")
    return docs.withColumns({n: F.lit("x") for n in names})


def corpus(seed=1, n=60, vocabulary=400):
    """Random prose with shared passages, near copies, copies and odd rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 8))) for _ in range(vocabulary)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, out = text(50), []
    for i in range(n):
        body = text(rng.choice([3, 20, 40, 120, 300]))
        if i % 5 == 0:
            cut = body.split()
            at = rng.randint(0, len(cut))
            body = " ".join(cut[:at] + passage.split() + cut[at:])
        out.append(body)
    out += [out[3], out[7] + " tail", "", None, "   \n\t ", "one", "A B", text(5) + "\n" + text(40), passage + " " + passage, out[3]]
    return out
