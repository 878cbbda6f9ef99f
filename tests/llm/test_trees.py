"""Conversation tries and Merkle manifests beside plain Python, over borders of shards and builders."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from lodestone.llm import merkle, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, key long, depth long, n long"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, n long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    out = set()
    for k, m in members.items():
        sub = [x for x in members if x[:len(k)] == k]
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = [c for c in sorted(m) if len(whole[c]) == len(k)]
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], sum(not children[x] for x in sub),
                 sum((len(members[x]) - 1) * words(x) for x in sub), sha(",".join(map(str, ends)))))
    return out


def turns(seed, n):
    r = random.Random(seed)
    pool = [("user", "hello there"), ("user", "hello"), ("assistant", "a b  c\td"), (None, None), ("user", ""), ("", "é ü")]
    rows = []
    for c in r.sample(range(3 * n), n):
        if r.random() < 0.4:  # a third and more are one conversation
            rows += [(c, i, "user", f"same {i}") for i in range(5)]
        else:
            rows += [(c, r.choice([None, i, i]), *r.choice(pool)) for i in range(r.randint(1, 6))]
    rows += [(None, 1, "user", "x"), rows[0], rows[0]]
    r.shuffle(rows)
    return [(*x, 1, 2, 3) for x in rows]


@pytest.mark.parametrize("size", [3, 16, 4096])
def test_trie(spark, size):
    rows = turns(size, 90)
    got = [tuple(r) for r in prefix_trie.nodes(spark.createDataFrame(rows, TURNS).repartition(4), size).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_trie(rows)


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(20, i, "user", f"turn {i}", 0, 0, 0) for i in range(3000)] + [(27, None, "a", "x", 0, 0, 0)]
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.nodes(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[20, 3000]["n_children"] == 0 and got[20, 0]["n_leaves"] == len({k[0] for k in got if k[1]})
    assert prefix_trie.nodes(spark.createDataFrame([], TURNS)).count() == 0


def test_positions():
    for n in [1, 2, 7, 8, 9, 63, 64, 65, 130, 513]:
        h = merkle.height(n)
        leaves = [sha(str(i)) for i in range(n)]
        log = "".join(merkle.build(leaves, h))
        level, at = leaves, 0
        while True:
            for j, x in enumerate(level):
                p = int(merkle.position(at, j, n, h))
                assert log[64 * p:64 * p + 64] == x
            if len(level) == 1:
                break
            level, at = [sha("".join(level[i:i + 8])) for i in range(0, len(level), 8)], at + 1
        assert at == h and log.endswith(level[0])
        for i in {0, n // 2, n - 1}:
            assert merkle.fold(leaves[i], merkle.siblings(log, i, n, h)) == level[0]


def plain_manifest(rows):
    def enc(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def digest(doc, text):
        return sha("".join(enc(x) for x in (doc[0], doc[3], doc[2], doc[4], text)))

    trees = collections.defaultdict(list)
    for k, d in enumerate(rows):
        trees[d[2]].append(((d[0] is not None, d[0] or 0, digest(d, d[1])), k))
    steps = collections.defaultdict(list)

    def climb(nodes):  # (digest, rows below)
        while len(nodes) > 1:
            up = []
            for i in range(0, len(nodes), 8):
                run = nodes[i:i + 8]
                for j, (_, below) in enumerate(run):
                    for k in below:
                        steps[k].append(("".join(x for x, _ in run[:j]), "".join(x for x, _ in run[j + 1:])))
                up.append((sha("".join(x for x, _ in run)), [k for _, b in run for k in b]))
            nodes = up
        return nodes[0]

    tops = [climb([(o[2], [k]) for o, k in sorted(v)]) for _, v in sorted(trees.items(), key=lambda x: (x[0] is not None, (x[0] or "").encode()))]
    subroot = {k: x for x, below in tops for k in below}
    root = climb(tops)[0]
    out = []
    for k, d in enumerate(rows):
        text = d[1]
        if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and text is not None:
            text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        folded = digest(d, text)
        for a, b in steps[k]:
            folded = sha(a + folded + b)
        out.append((d[0], digest(d, d[1]), subroot[k], root, sha("".join(a + b for a, b in steps[k])), folded, folded == root))
    return collections.Counter(out)


@pytest.mark.parametrize(("n", "levels"), [(1, 4), (9, 1), (150, 1), (700, 2), (200, 4)])
def test_manifest(spark, n, levels):
    r = random.Random(n)
    langs = [None, "", "-", "en", "é", *[f"l{i}" for i in range(r.choice([0, 80]))]]
    rows = [(i * 7 - 50, r.choice([None, "", "Ab C", "É x", "low"]) if r.random() < 0.5 else f"Text {i}", r.choice(langs) if r.random() < 0.6 else "en",
             r.choice([None, "s"]), r.choice([None, i]), "t", 1, 1) for i in range(n)]
    rows += [rows[0], (None, "N", "en", None, None, None, None, None)] if n > 1 else []
    got = merkle.prove(spark.createDataFrame(rows, DOCS).repartition(3), levels).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert collections.Counter(tuple(x) for x in got.collect()) == plain_manifest(rows)


def test_no_documents(spark):
    assert merkle.prove(spark.createDataFrame([], DOCS)).count() == 0
