"""Share of linked pairs that line de-duplication joins, by band of similarity and length of line."""

import random

from idweave.llm import line_dedup


def shingles(x):
    return {x[k : k + 5] for k in range(len(x) - 4)} if len(x) > 5 else {x}


def edited(line, rng, edits):
    for _ in range(edits):
        at = rng.randrange(len(line))
        kind = rng.randrange(3)
        line = line[:at] + (rng.choice("abcdefgh ") if kind else "") + line[at + (kind < 2) :]
    return line


def test_recall_of_edited_copies(spark):
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    pairs = []
    for n in [*range(2, 12)] * 60 + [*range(12, 120, 6)] * 30:
        line = " ".join(rng.choice(words) for _ in range(n))
        other = edited(line, rng, max(1, rng.randint(0, len(line) // 45)))
        both = len(shingles(line) & shingles(other))
        similarity = both / (len(shingles(line)) + len(shingles(other)) - both)
        if similarity >= 0.8:
            pairs.append((line, other, similarity))
    got = line_dedup.mark_lines(spark.createDataFrame([(k, x) for k, (a, b, _) in enumerate(pairs) for x in (f"{a}\n{b}",)], "doc_id long, text string"))
    first = {(r["doc_id"], r["line_no"]): (r["first_id"], r["first_line_no"]) for r in got.collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        for short in (True, False):
            own = [first[k, 0] == first[k, 1] for k, (a, _, s) in enumerate(pairs) if low <= s < high and (len(a) < 80) == short]
            assert len(own) > 40 and sum(own) >= 0.99 * len(own) - 1, (low, short, sum(own), len(own))
