"""Prefix trees of posting lists beside all pairs, and lists of many sets that do not link."""

import random

import numpy as np
import pytest

from lodestone.llm import ngram_join


def sets(seed, n):
    r = random.Random(seed)
    common = [r.getrandbits(62) for _ in range(40)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            x = set(r.choice(out))
            for _ in range(r.randint(0, 8)):
                x.discard(r.choice(sorted(x)))
                x.add(r.getrandbits(62))
        else:
            x = {r.getrandbits(62) for _ in range(r.randint(1, 60))}
        out.append(x | set(r.sample(common, r.randint(1, 40))))
    return out


def links(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_every_partner(seed):
    every = sets(seed, 60)
    rare = {t: sum(t in s for s in every) for s in every for t in s}
    paths = [np.array(sorted(s, key=lambda t: (rare[t], t)), np.int64) for s in every]
    tree = ngram_join.Tree(paths, [len(p) for p in paths])
    for i, s in enumerate(every):
        own = np.sort(paths[i])
        found = {j for j, o in tree.partners(own, len(own), lambda _: True) if o * 180 >= 80 * (len(s) + len(every[j]))}
        assert found == {j for j, x in enumerate(every) if links(s, x)}


def test_paths_with_long_equal_beginnings_and_repeats():
    base = np.arange(100, dtype=np.int64)
    paths = [base, base, base[:90], np.concatenate([base[:50], base[60:]]), base[:10]]
    tree = ngram_join.Tree(paths, [len(p) for p in paths])
    got = {j: o for j, o in tree.partners(base, 100, lambda _: True)}
    assert {j for j, o in got.items() if o * 180 >= 80 * (100 + len(paths[j]))} == {0, 1, 2, 3}
    assert (got[0], got[1], got[2], got[3]) == (100, 100, 90, 90)


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_lists_in_chunks(spark, chunk):
    every = sets(9, 120)
    rows = [(i, len(s), [int(t) for t in sorted(s)]) for i, s in enumerate(every)]
    s = spark.createDataFrame(rows, "sid long, n int, toks array<long>")
    entries = spark.createDataFrame([(7, i, i) for i in range(len(every))], "tok long, sid long, comp long")
    got = [(r["a"], r["b"]) for r in ngram_join.list_links(entries, s, chunk).collect()]
    assert all(links(every[a], every[b]) for a, b in got)

    def groups(pairs):
        up = list(range(len(every)))

        def top(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in pairs:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return [top(i) for i in range(len(every))]

    want = [(a, b) for a in range(len(every)) for b in range(a) if links(every[a], every[b])]
    assert groups(got) == groups(want)
    if chunk == 1 << 20:  # a forest: no link that joins nothing
        assert len(got) == len(every) - len(set(groups(want)))


def test_common_lines_without_links(spark):
    """Documents of the same lines that do not link yield no pair rows, and stay apart."""
    r = random.Random(2)
    lines = [" ".join(f"w{r.randrange(300)}" for _ in range(30)) for _ in range(6)]
    rows = [(i, " ".join([*r.sample(lines, 3), *(f"u{i}x{k}" for k in range(40))])) for i in range(150)] + [(900, None), (901, " ")]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in rows}
