"""License notices in every block of words, against all windows."""

import random

from memlake.llm.licenses import TEMPLATES, scan_licenses

BSD = "redistribution and use in source and binary forms with or without modification are permitted".split()


def brute(text, templates, window=32):
    words, labels, score = text.split(), set(), 0.0
    for label, template in templates:
        own = set(template.split())
        for start in range(len(words)):
            share = len(own & set(words[start : start + max(window, 2 * len(own))])) / len(own)
            if share * 100 >= 80 - 1e-9:
                labels.add(label)
                score = max(score, share)
    return ",".join(sorted(labels)), round(score, 9)


def scanned(spark, texts, *args):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in scan_licenses(rows, *args).collect()}


def test_every_offset(spark):
    """A sentence with words put in is found wherever it begins."""
    notice = " ".join(w for i, word in enumerate(BSD) for w in ([word, f"x{i}"]))
    texts = [" ".join([*(f"f{i}" for i in range(n)), notice, "end"]) for n in range(33)]
    assert scanned(spark, texts) == {n: ("bsd", 1.0) for n in range(33)}


def test_against_all_windows(spark):
    draw = random.Random(7)
    long = " ".join(f"long{i}" for i in range(45))
    many = [(f"m{j}", " ".join(f"w{j}x{i}" for i in range(9))) for j in range(16)]
    templates = [*TEMPLATES, ("long", long), *many]
    texts = []
    for _ in range(150):
        words = draw.choice(templates)[1].split()
        put = [w for word in words for w in [word] * (draw.random() < 0.9) + ["filler"] * draw.choice([0, 0, 1, 2])]
        texts.append(" ".join(["a"] * draw.randrange(40) + put + ["of"] * draw.randrange(40) + draw.choice(templates)[1].split()[: draw.randrange(9)]))
    found = scanned(spark, texts, templates)
    assert found == {i: brute(text, templates) for i, text in enumerate(texts)}
    assert any("long" in labels for labels, _ in found.values()) and any("m15" in labels for labels, _ in found.values())
