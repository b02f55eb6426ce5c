"""Line dedup in fewer readings and larger batches."""

import random

import numpy as np

from tessera.llm import lines


def family(seed, n, length=90, edits=6):
    """Lines of random words, each with some characters of the one before changed: neighbours are alike, far ones are not."""
    r = random.Random(seed)
    line = [r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(length)]
    out = []
    for _ in range(n):
        for _ in range(edits):
            line[r.randrange(1, length - 1)] = r.choice("abcdefghijklmnopqrstuvwxyz")
        out.append("x" + "".join(line)[1:-1] + "x")
    return out


def test_documents_are_read_once_for_the_texts_of_lines(spark, monkeypatch):
    """Both phases take lines from one reading, in batches of many documents, and what is removed is so by brute force, 98 % of it at least."""
    calls, held = [], lines._texts

    def counting(docs, distinct):
        read = held(docs, distinct)
        return lambda ids: calls.append(1) or read(ids)

    monkeypatch.setattr(lines, "_texts", counting)
    every = [x for seed in range(30) for x in family(seed, 12, edits=2)]
    rows = [(i, "\n".join(every[i * 4 : i * 4 + 4])) for i in range(len(every) // 4)]
    got = {r["doc_id"]: r["removed"] for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(calls) == 1
    sets, root = [lines.character_shingles(x) for x in every], list(range(len(every)))
    for i in range(len(every)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= lines.PERCENT * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    want = {d: [n for n in range(4) if root[d * 4 + n] != d * 4 + n] for d, _ in rows}
    ours, plain = ({(d, n) for d, gone in x.items() for n in gone} for x in (got, want))
    assert len(plain) > 100 and ours <= plain and len(ours) >= 0.98 * len(plain)


def test_numbers_of_characters_on_both_sides_of_the_limit():
    """Small code points stand for themselves, others are numbered; sets are as by the shingles themselves."""
    for texts in (["abcdefgh", "bcdefgh", "abc"], ["abcde" + chr(4094), "bcde" + chr(4094), "a"], ["abcde" + chr(4095), "bcde" + chr(4095), "a"], ["日本語日本語日本", "本語日本語日本", "日"]):
        sets, plain = lines.numbered_sets(texts), [lines.character_shingles(x) for x in texts]
        for a, p in zip(sets, plain):
            assert len(a) == len(p) and (np.diff(a) > 0).all()
            for b, q in zip(sets, plain):
                assert len(np.intersect1d(a, b)) == len(p & q)
