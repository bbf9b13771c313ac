"""Fill-in-the-middle, vector codes and toxicity against brute force, on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import fim, toxicity, vectors

# op11


def brute_middle(id_, text):
    """By a list of all units, which the operator never makes."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check_middle(df, rows):
    made = fim.fill_in_middle(df)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restore().alias("restored")).collect()
    want = sorted(((i, *brute_middle(i, t), t or "") for i, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    return want


def test_middle(spark, docs, rows, empty):
    want = check_middle(docs, [r[:2] for r in rows])
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    made = fim.fill_in_middle(docs)
    assert made.columns == [c for c in docs.columns if c != "text"] + ["n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(r.budget for r in made.collect()) == sorted(r[-1] for r in rows)
    assert fim.fill_in_middle(empty).count() == 0


def test_middle_of_odd_texts(spark):
    r = random.Random(2)
    marks = ["a", "\n", "\n", "😀", "é", "<", "<P", "P>", ">", "<S", "M>", "<M", "\r", " ", " "]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    texts += ["x<P>y", "<S>", "a\n<M>\n", None, "", "\n", "\n" * 50, "no newline", "last\n", "line\n" * 200_000, "z" * 1_000_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (3, texts[3]), (3, texts[3])]
    want = check_middle(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rows)
    assert {w[2] for w in want if w[0] is not None and w[0] >= 1500} >= {"plain"}


def test_middle_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a\nb", 5, 6, 7, (1, 2))], "doc_id bigint, text string, `a.b` int, n int, kept int, s struct<`x y`:int,`z.w`:int>")
    row = fim.fill_in_middle(df).first()
    assert (row["a.b"], row["kept"], row["s"]["x y"], row["n"]) == (5, 7, 1, 2)


def test_middle_rates_and_units(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"))
    rows = fim.fill_in_middle(df, unit=r"\S+\s*", rate=50, spm=25, markers=("[pre]", "[suf]", "[mid]")).withColumn("back", fim.restore(markers=("[pre]", "[suf]", "[mid]"))).collect()
    assert {r.back for r in rows} == {"one two three four"} and {r.n for r in rows} == {4}
    plain = sum(r.form == "plain" for r in rows)
    assert 140 < plain < 260 and sum(r.form == "spm" for r in rows) < sum(r.form == "psm" for r in rows)


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aba", "q", "x"), ("", "q", "x"), ("abc", "b", "x")])
def test_markers_that_overlap_are_refused(spark, markers):
    with pytest.raises(ValueError):
        fim.check_markers(markers)


# op12


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [int(np.floor(np.float64(x) * 4096)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    if not any(i is not None for i, _, _ in kept):
        return []
    size = len(min((k for k in kept if k[0] is not None), key=lambda k: (k[0], len(k[1])))[1])
    kept = [k for k in kept if len(k[1]) == size]
    width = size // parts
    first = {}
    for i, v, _ in kept:
        if i is not None and (i not in first or v < first[i]):
            first[i] = v
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(first[i])[p] for i in sorted(first)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        sums = {}
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                sums.setdefault((p, near(p, x)[1]), []).append(x)
        books = [[[sum(c) // len(c) for c in zip(*sums[p, e], strict=True)] if (p, e) in sums else old for e, old in enumerate(book)] for p, book in enumerate(books)]
    out = []
    for i, v, label in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(i, code, error, sum(o[2] for o in out if o[3] == label), digest) for i, code, error, label in out]


VECTORS = "vec_id bigint, embedding array<float>, label int"


def check_codes(spark, rows, slices=3):
    got = vectors.compress(spark.createDataFrame(rows, VECTORS).repartition(slices)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    exact = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, label) for i, v, label in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(brute_codes(exact), key=repr)
    return got


def test_codes(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), r.normal(0, 0.3, 16).tolist(), int(i % 4)) for i in r.permutation(300)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [None] + [0.1] * 15, 1), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] + [0.0] * 15, 2), (1005, [0.5] * 8, 2)]
    rows += [rows[0], rows[0], (rows[5][0], [0.25] * 16, None), (None, [0.1] * 16, None), (2000, [-0.0] * 16, None)]
    assert len(check_codes(spark, rows)) == 305


def test_codes_of_ties_few_and_no_vectors(spark):
    check_codes(spark, [(i, [0.0, 1.0] * 8, 0) for i in range(40)])  # all entries are equal: the first one counts
    check_codes(spark, [(i, [float(i % 3)] * 8, None) for i in range(5)])
    assert check_codes(spark, [(7, [0.5] * 8, 1)])[0].error == 0
    assert check_codes(spark, [(None, [0.5] * 8, 1)]) == []
    assert check_codes(spark, []) == []


def test_codes_of_far_components_saturate(spark):
    rows = [(i, [1e30 if i % 2 else -1e30] * 8, 0) for i in range(20)]
    got = vectors.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.error for r in got} == {0} and len({r.code for r in got}) == 2


def test_codes_do_not_depend_on_the_dealing(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(0, 0.3, 16).tolist(), 0 if i % 3 else 1) for i in range(500)]
    one, two = (sorted(map(tuple, vectors.compress(spark.createDataFrame(rows, VECTORS).repartition(n)).collect())) for n in (1, 7))
    assert one == two


def test_codes_refuse_parts_that_do_not_fit(spark):
    with pytest.raises(ValueError):
        vectors.compress(spark.createDataFrame([(1, [0.5] * 9, 1)], VECTORS))


# op13


def brute_kernel(a, b, decay=toxicity.DECAY, orders=toxicity.ORDERS):
    from itertools import combinations

    def weights(word):
        out = {}
        for n in orders:
            for at in combinations(range(len(word)), n):
                key = "".join(word[i] for i in at)
                out[key] = out.get(key, 0.0) + decay ** (at[-1] - at[0] + 1 - n)
        return out

    x, y = weights(a), weights(b)
    dot = lambda u, v: sum(w * v.get(k, 0.0) for k, w in u.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def test_kernel_counts_common_subsequences():
    r = random.Random(6)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(3, 9))) for _ in range(30)] + ["aaaaaa", "idiot", "idxiot", "xyz"]
    kernel = toxicity.Kernel.of(words[:12] + ["idiot"])
    want = [[brute_kernel(w, v) for v in kernel.landmarks] for w in words]
    assert np.allclose(kernel.values(words), want, atol=1e-4)


def test_words_are_folded():
    assert [toxicity.fold(x) for x in ("IDIOT!!", "i.d-i_o*t", "1d10t", "Réeux,", "***", "42", "ﬁne")] == ["idiot", "idiot", "idiot", "reeux", "", "", "fine"]
    assert toxicity.units("You i d i o t , a b") == ["idiot", "you"]
    long = toxicity.units("x" * 100 + "stupid" + "y" * 100)
    assert any("stupid" in w for w in long) and all(len(w) <= toxicity.LONGEST for w in long)
    text = "One. Two!! Three\nfour 3.5 five"
    assert list(toxicity.sentences(text)) == ["One", " Two", " Three", "four 3.5 five"]


INSULTS = ("blockhead", "nincompoop", "scoundrel", "dimwit")


def toxic_rows(n=900, seed=8):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(("th", "er", "on", "an", "ti", "es")) for _ in range(r.randint(1, 4))) for _ in range(500)]
    rows, labels, shapes = [], [], {}
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                word = r.choice(INSULTS)
                if zlib.crc32(str(i).encode()) % 3 == 1 and i % 8 == 0:  # held-out insults that no training text spells so
                    k = r.randint(2, len(word) - 2)
                    word = r.choice((word[:k] + "x" + word[k:], " ".join(word), "-".join(word), word.upper() + "!!", word[:k] + word[k] * 2 + word[k + 1 :]))
                words.insert(r.randrange(len(words)), word)
        for k in range(9, len(words), 10):
            words[k] += "."
        rows.append((i, " ".join(words), "x", 1))
        if r.random() < 0.9:
            labels.append((i, int(toxic if r.random() < 0.97 else not toxic), 1.0))
        shapes[i] = toxic
    return rows, labels, shapes


def test_toxicity(spark):
    rows, labels, toxic = toxic_rows()
    odd = [(5000, None, "x", 1), (5001, "", "x", 1), (5002, " \n\t", "x", 1), (5003, "12 34 ! ?", "x", 1), (5004, "blockhead " * 3 + "dimwit scoundrel " + "esti " * 200_000, "x", 1), (5005, "q" * 1_000_000, "x", 1), (None, rows[0][1], "x", 1), rows[0], rows[0]]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, score string, toxic int").repartition(4)
    marks = spark.createDataFrame(labels + [(None, 1, 1.0), (7, None, 1.0), labels[0]], "doc_id bigint, toxic int, text double")
    machine = toxicity.learn(df, marks)
    got = toxicity.score(df, machine).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        by_id.setdefault(r.doc_id, []).append((r.score, r.predicted))
    assert len(set(by_id[0])) == 1 and len(by_id[0]) == 3
    held = [i for i in toxic if zlib.crc32(str(i).encode()) % 3 == 1]
    caught = [by_id[i][0][1] for i in held if toxic[i]]
    assert np.mean(caught) >= 0.9
    assert np.mean([by_id[i][0][1] for i in held if not toxic[i]]) <= 0.03
    bent = [by_id[i][0][1] for i in held if toxic[i] and i % 8 == 0]
    assert len(bent) > 15 and np.mean(bent) >= 0.75
    assert {by_id[i][0][1] for i in (5000, 5001, 5002, 5003, 5005)} == {0}
    again = toxicity.score(df.repartition(2), toxicity.learn(df.repartition(2), marks)).collect()
    before = {r.doc_id: r.score for r in got}
    assert all(abs(r.score - before[r.doc_id]) < 1e-5 for r in again)


def test_toxicity_with_little_to_learn_from(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {(0.0, 0)}
    alike = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, alike)).collect()} == {1.0}
    few = spark.createDataFrame([(i, int(i == 4)) for i in range(30)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, few)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, toxicity.learn(empty, few)).count() == 0


def test_toxicity_learns_from_no_held_out_label(spark):
    rows, labels, _ = toxic_rows(200)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string, toxic int")
    schema = "doc_id bigint, toxic int, text double"
    bent = [(i, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t, x) for i, t, x in labels]
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.score(df, toxicity.learn(df, spark.createDataFrame(x, schema))).collect()) for x in (labels, bent))
    assert one == two
