"""Language identification: subword counts beside plain Python, held-out accuracy, what it may learn from."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, score double, place int, h long"
SYLLABLES = {"aa": "ka lo mi tu re", "bb": "sch ung ein zu ö", "cc": "que ado ción ñi la"}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = []
    for i in range(400):
        lang = r.choice(["aa", "bb", "cc"])
        out.append((i, text(r, lang, r.choice([3, 20, 200])), lang, "s", 0.0, 1, 1))
    odd = [None, "", " \n 12 345 -- ", "!?"]
    out += [(1000 + i, t, "aa", "s", 0.0, 1, 1) for i, t in enumerate(odd)]
    return [*out, (None, out[0][1], None, None, None, None, None), out[5], out[5]]


def plain_counts(s):
    out = np.zeros(langid.BUCKETS, np.int64)
    for word in "".join(c if c.isalpha() else " " for c in s.lower()).split():
        x = [0, *map(ord, word), 0]
        for n in langid.GRAMS:
            for i in range(len(x) - n + 1):
                h = (n + sum((c + 1) * int(m) for c, m in zip(x[i:i + n], langid._MULT, strict=False))) % 2 ** 64
                out[int(langid.mix64(np.array([h], np.uint64))[0]) >> 50] += 1
    return out


def test_counts_of_whole_texts(monkeypatch):
    words = langid.Subwords()
    s = "Straße, l'été  Ab--x 3rd ñandú\n\tΑθήνα a"
    assert (words.counts(s) == plain_counts(s)).all()
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "CHARS", size)
        assert (words.counts(s) == plain_counts(s)).all()


def test_accuracy_and_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    kept = [x for x in rows[:400] if held(x[0])]
    assert sum(by[x[0]]["lang_pred"] == x[2] for x in kept) >= 0.97 * len(kept)
    assert all(by[i]["held_out"] == held(i) for i in by if i is not None) and not by[None]["held_out"]
    assert all((by[1000 + i]["lang_pred"], by[1000 + i]["score"], by[1000 + i]["rejected"]) == ("und", 0, True) for i in range(4))
    assert all(0 <= r["score"] <= 1 for r in got) and by[None]["lang_pred"] == by[0]["lang_pred"]
    # Scores are probabilities: their mean is near the share that is right.
    right = np.mean([by[x[0]]["lang_pred"] == x[2] for x in kept])
    assert abs(np.mean([by[x[0]]["score"] for x in kept]) - right) < 0.1
    assert np.mean([by[x[0]]["rejected"] for x in kept]) < 0.1


def test_held_out_documents_and_ids_teach_nothing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    other = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(str, langid.identify(x).collect())) for x in (df, other))
    assert a == b


def test_bounded_sample(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    few = langid.sample(df, 30)
    assert 20 <= len(few) <= 30 and len({r["lang"] for r in few}) == 3


def test_nothing_to_learn_from(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert langid.identify(df.filter("false")).count() == 0
