"""Every operator against brute force, on rows with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import fingerprints, language, lines, mixing, packing, quality, simhash, substrings, token_files, urls
from graphloom.llm.components import components
from graphloom.llm.tokens import PieceEncoder, encoded
from tests_llm_brute import brute_components, brute_fingerprint, brute_lines, crc, ids_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def thue_morse(n=2048):
    """Two words that sums of bytes times powers of any odd number modulo 2**64 can't tell apart."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_piece_encoder_gives_the_tokenizer_s_ids(tokenizer):
    r = random.Random(3)
    marks = ["a", "Zeta", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u3000", "\u2003", "\x1c", "\x7f", ".", ",", "'s", "'", "1", "42", "😀", "<|endoftext|>", "日本", "\r\n", "-", "\u0085", "ñ", "ªµº", "×", "÷", "ŭ", "ɐ", "à.", "ö'", "Ñ9", "í" * 40, "x" * 70]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [None, "", *thue_morse()]
    encoder = PieceEncoder(remembered=50)
    got = []
    for _, ids, counts in encoded(pa.array(texts), encoder, 500):
        ends = np.cumsum(counts)
        got += [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
    assert got == [ids_of(tokenizer, t) for t in texts]


def test_special_strings_get_the_ids_of_a_plain_call(spark, tmp_path):
    """op2 and op6 against encode(add_special_tokens=False) of the tokenizer as it is loaded."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    marks = ["a", "Zeta", "é", " ", "  ", "\n", "\n\n", "\t", "\u00a0", ".", "'s", "1", "日本", "<|endoftext|>", "<|endoftext|>", "<|", "endoftext", "|>", "-"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endof", "text|>", "a<|endoftext|><|endoftext|>b"] + ["".join(r.choice(marks) for _ in range(r.randint(0, 30))) for _ in range(500)]
    want = {i: ids_of(plain, x) for i, x in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    pieces = packing.token_pieces(df).collect()
    assert {p.doc_id: np.frombuffer(bytes(p.ids), "<u4").tolist() for p in pieces} == want
    token_files.write_token_files(df, str(tmp_path / "t"))
    rows = token_files.decode_segments(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert {x.doc_id: np.frombuffer(bytes(x.ids), "<u4").tolist() for x in rows} == want


# op1


def test_fingerprints_edit_and_algebra(spark, unique, unique_docs):
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(unique_docs).collect()}
    order = sorted(unique, key=lambda r: -r[0])
    for i, row in enumerate(order):
        text, following = row[1] or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        r = got[row[0]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.edited_fingerprint == r.fingerprint) == (sorted(edited.split("\n")) == sorted(text.split("\n")))
    long = [r for r in got.values() if r.n_chars > 600]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.9 * len(long)
    by_text = defaultdict(set)
    for row in unique:
        by_text[row[1] or ""].add(got[row[0]].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)


def brute_soft(text):
    """The soft lanes of a text as sums of signs."""
    def chained(words):
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        return seed

    hashes = []
    for line in (text or "").split("\n"):
        w = re.split(r"[\x20\x09-\x0D]+", line)
        hashes += [chained([" ".join(w)])] if len(w) <= 3 else [chained(w[i : i + 3]) for i in range(len(w) - 2)]
    bits = np.array([[h >> b & 1 for b in range(64)] for h in hashes])
    return 2.0 * bits.sum(axis=0) - len(hashes)


def test_fingerprints_likeness(unique, unique_docs):
    order = sorted((r for r in unique if len(r[1] or "") < 20_000), key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(unique_docs.where("coalesce(length(text), 0) < 20000")).collect()}
    for i, row in enumerate(order):
        text, following = row[1] or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        r = got[row[0]]
        for other, near, same in ((edited, r.near_edited, r.fingerprint == r.edited_fingerprint), (following, r.near_next, None)):
            a, b = brute_soft(text), brute_soft(other)
            want = 1.0 if sorted(other.split("\n")) == sorted(text.split("\n")) else max(0.0, min(1.0, a @ b / np.sqrt((a @ a) * (b @ b)))) if (a @ a) * (b @ b) else 0.0
            assert abs(near - want) < 1e-9


def test_fingerprints_repeated_and_null_ids(docs, rows, empty):
    got = fingerprints.edited_fingerprints(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    texts = {r[1] or "" for r in rows}
    assert len({r.fingerprint for r in got}) == len(texts)
    assert Counter(Counter(r.fingerprint for r in got).values()) == Counter(Counter(r[1] or "" for r in rows).values())
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_fingerprints_add_and_take_away(spark):
    texts = [("ab", "one two three four\nfive six"), ("ba", "five six\none two three four"), ("a", "one two three four"), ("b", "five six")]
    rows = fingerprints.fingerprint_columns(spark.createDataFrame(texts, "name string, text string"), {"text": "f"})
    f = {r.name: r.f for r in rows.collect()}
    assert f["ab"] == f["ba"]
    row = spark.createDataFrame([(f["a"], f["b"], f["ab"])], "a string, b string, ab string")
    out = row.select(fingerprints.inserted("a", "b").alias("sum"), fingerprints.deleted("ab", "b").alias("rest")).first()
    assert (out["sum"], out["rest"]) == (f["ab"], f["a"])


# op2


def check_packed(got, docs, tokenizer, capacity):
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for doc, text in docs:
        ids, at = ids_of(tokenizer, text), 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    used = sum(r.length for r in got)
    assert used >= 0.9 * capacity * (len(placed) - 1)


def test_packing(spark, unique, unique_docs, docs, rows, empty, tokenizer):
    cut = packing.token_pieces(unique_docs).withColumn("ids_crc32", F.crc32("ids"))
    packed = packing.pack(cut.persist())
    check_packed(packed.collect(), [(r[0], r[1]) for r in unique], tokenizer, packing.CAPACITY)
    sequences = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in sequences.values())
    again = packing.pack(packing.token_pieces(docs).drop("ids").persist()).collect()
    assert sum(r.length for r in again) == sum(len(ids_of(tokenizer, r[1])) for r in rows)
    assert len({(r.sequence_id, r.offset) for r in again}) == len(again)
    assert packing.pack(packing.token_pieces(empty).persist()).count() == 0


def test_shortest_pack_first_places_every_length():
    r = random.Random(5)
    for _ in range(30):
        histogram = {n: r.randint(1, 50) for n in r.sample(range(1, 65), r.randint(1, 40))}
        patterns = packing.shortest_pack_first(histogram, 64)
        placed = Counter()
        for count, lengths in patterns:
            assert sum(lengths) <= 64 and list(lengths) == sorted(lengths, reverse=True)
            for n in lengths:
                placed[n] += count
        assert placed == Counter(histogram)


# op3


def test_language(docs, rows, empty, spark):
    got = language.identify(docs, language.learn(docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    text = {r[0]: r for r in rows}
    for r in got:
        if r.doc_id is not None and r.doc_id != 6:
            letters = any(c.isalpha() for c in text[r.doc_id][1] or "")
            assert (r.lang_pred == "und") == (not letters)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 60]
    assert held and sum(r.lang_pred == text[r.doc_id][2] for r in held) >= 0.8 * len(held)
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.learn(empty) is None and language.identify(empty, None).count() == 0


def test_language_copies_do_not_fill_the_sample(spark, rows):
    texts = [(r[0], r[1], r[2]) for r in rows if r[0] is not None and r[0] < 60 and r[0] != 6]
    many = [t for t in texts for _ in range(200 if t[2] == "en" else 1)]
    docs = spark.createDataFrame(many, "doc_id bigint, text string, lang string").repartition(3)
    found = language.learn(docs, sample=64)
    assert sorted(x for members in found.members.values() for x in members) == ["de", "en", "es", "fr"]
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs, found).collect()}
    assert sum((i, lang) in got for i, _, lang in texts) >= 0.8 * len(texts)


def test_language_decision_rule():
    """predict() against votes counted one by one."""
    r = np.random.default_rng(3)
    x = r.random((60, 8)).astype(np.float32)
    names = r.choice(["en", "de", "nl", "fr", "es", "fi"], 60).tolist()
    found = language.Identifier(x, names)
    chance = lambda v, w: 1 / (1 + np.exp(-4 * (np.append(v, 1) @ w)))
    got, scores = found.predict(x)
    for v, name, score in zip(x, got, scores, strict=True):
        margins = [np.append(v, 1) @ w for w in found.family_weights.T]
        family = found.families[int(np.argmax(margins))]
        members, votes, worst = found.members[family], Counter(), {}
        for i, j, w in found.pairs[family]:
            p = chance(v, w)
            for side, q in ((members[i], p), (members[j], 1 - p)):
                votes[side] += int(q >= 0.5) + q / (2 * len(members))
                worst[side] = min(worst.get(side, 1), q)
        want = max(members, key=lambda m: (votes[m], -members.index(m)))
        assert name == want and abs(score - chance(v, found.family_weights[:, np.argmax(margins)]) * worst.get(want, 1)) < 1e-5


# op4


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def url_rows():
    r = random.Random(7)
    out = [(i, f"http{'s' * (i % 2)}://{r.choice(['www.', 'M.', ''])}{r.choice(['alpha', 'BETA', 'cheap-pills'])}.example.{r.choice(['org', 'com', 'net'])}/{r.choice(['en', 'de', 'fr', 'es'])}/{r.randint(1, 400)}{r.choice(['', '?a=/org/', '#x'])}", "h") for i in range(400)]
    out += [(400, None, "h"), (401, "", "h"), (402, "no scheme", "h"), (403, "x://org", "h"), (404, "http://org/", "h"), (405, "http://a.org?x://y/", "h"), (406, "http://É.example.org/es/1", "h"), out[3], (None, out[4][1], "h")]
    return out


def brute_scores(rows, order=urls.ORDER):
    text, labelled = {}, defaultdict(list)
    for _, url, _ in rows:
        host, path, _, verdict = brute_rule(url)
        full = "\x01" * order + host + path
        text[(host, path)] = full
        if verdict and zlib.crc32(f"{host}/{path}".encode()) % urls.FOLDS:
            labelled[verdict].append(full)
    models = {}
    for v, texts in labelled.items():
        c = Counter(t[i - k : i + 1] for t in texts for i in range(order, len(t)) for k in range(order + 1))
        follow = defaultdict(Counter)
        for gram, n in c.items():
            follow[gram[:-1]][gram[-1]] += n
        models[v] = follow

    def log_p(model, gram):
        p = 1 / urls.ALPHABET
        for k in range(order + 1):
            f = model.get(gram[order - k : order])
            if f:
                n, t = sum(f.values()), len(f)
                p = (f[gram[-1]] + t * p) / (n + t)
        return np.log(p)

    out = {}
    for key, t in text.items():
        grams = [t[i - order : i + 1] for i in range(order, len(t))]
        out[key] = np.mean([log_p(models["allow"], g) - log_p(models["block"], g) for g in grams]) if grams else 0.0
    return out


def test_urls(spark):
    rows = url_rows()
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    want = {r[0]: brute_rule(r[1]) for r in rows}
    scores = brute_scores(rows)
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert r.score == pytest.approx(scores[(host, path)], abs=1e-9)
    free = [(r.score, r.verdict) for r in got if r.rule is None]
    assert min([s for s, v in free if v == "allow"], default=9) >= max([s for s, v in free if v == "block"], default=-9)
    none = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id bigint, url string")
    assert {r.verdict for r in urls.judge(none).collect()} == {"allow"}
    assert urls.judge(none.where("false")).count() == 0


# op5


def brute_budgets(tree, weights, given, epochs):
    """tree: nested dicts down to token counts."""
    if not isinstance(tree, dict):
        return given
    capacity = lambda t: t * epochs if not isinstance(t, dict) else sum(map(capacity, t.values()))
    left, out, open_ = given, {}, dict(tree)
    while True:
        total = sum(weights.get(k, 1.0) for k in open_)
        full = [k for k in open_ if capacity(open_[k]) <= left * weights.get(k, 1.0) / total + 1e-9]
        if not full:
            break
        k = min(full, key=lambda k: capacity(open_[k]) / weights.get(k, 1.0))
        out[k] = capacity(open_.pop(k))
        left -= out[k]
        if not open_:
            break
    total = sum(weights.get(k, 1.0) for k in open_)
    out |= {k: left * weights.get(k, 1.0) / total for k in open_}
    return {k: brute_budgets(tree[k], weights, out[k], epochs) for k in tree}


def test_mixing(spark, docs, empty):
    weights = {"domain": {"web": 3.0, "reference": 1.0}, "lang": {"en": 5.0, "de": 1.0}}
    tokens = mixing.with_domain(docs).withColumn("tokens", mixing.n_tokens())
    rows = tokens.select("doc_id", "domain", "lang", "source", "tokens").collect()
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for r in rows:
        tree[r.domain][r.lang][r.source] += r.tokens
    tree = {k: {j: dict(w) for j, w in v.items()} for k, v in tree.items()}
    flat = {k: v for level in weights.values() for k, v in level.items()}
    for total in (None, 500.0, 200_000.0):
        got = mixing.mix(tokens, weights=weights, total=total).collect()
        assert len(got) == len(rows)
        everything = sum(r.tokens for r in rows)
        want = brute_budgets(tree, flat, min(total or everything, 4.0 * everything), 4)
        taken = defaultdict(list)
        for r in got:
            assert r.budget == pytest.approx(want[r.domain][r.lang][r.source], abs=1.01)
            taken[(r.domain, r.lang, r.source)].append(r)
        for leaf, rs in taken.items():
            n, budget = tree[leaf[0]][leaf[1]][leaf[2]], rs[0].budget
            epochs = min(4, budget // n) if n else 1
            order = lambda r: hashlib.md5(f"{mixing.SEED}:{epochs}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()  # noqa: B023, E731
            place = Counter()
            for r in rs:
                place[order(r)] += r.tokens
            before, fits = 0, {}
            for k in sorted(place):
                before += place[k]
                fits[k] = before <= budget - epochs * n
            assert all(r.copies == epochs + (epochs < 4 and fits[order(r)]) for r in rs)
    assert mixing.mix(mixing.with_domain(empty).withColumn("tokens", mixing.n_tokens())).count() == 0
    mixed = mixing.apply_mix(docs, weights=weights)
    assert mixed.columns == docs.columns and mixed.count() > 0


# op6


def test_token_files(spark, unique, unique_docs, docs, rows, empty, tokenizer, tmp_path):
    token_files.write_token_files(unique_docs, str(tmp_path / "a"))
    files = spark.read.parquet(str(tmp_path / "a"))
    bases = {(r.part, r.segment): r.base for r in token_files.segment_starts(files).collect()}
    start, got = 0, {}
    for r in token_files.decode_segments(files).collect():
        got[r.doc_id] = (bases[(r.part, r.segment)] + r.local_start, list(np.frombuffer(bytes(r.ids), "<u4")))
    for row in sorted(unique):
        ids = ids_of(tokenizer, row[1])
        assert got[row[0]] == (start, ids)
        start += len(ids)
    token_files.write_token_files(docs, str(tmp_path / "b"))
    assert token_files.decode_segments(spark.read.parquet(str(tmp_path / "b"))).count() == len(rows)
    token_files.write_token_files(empty, str(tmp_path / "c"))
    assert spark.read.schema(token_files.SEGMENTS).parquet(str(tmp_path / "c")).count() == 0


def test_any_token_is_addressed():
    r = np.random.default_rng(1)
    for high in (1, 200, 300, 50_257, 1 << 20, 1 << 32):
        ids = r.integers(0, high, 3000).astype(np.uint32)
        ids[:5] = 0
        segment = token_files.Segment(token_files.pack_levels(ids))
        assert (segment.all() == ids).all()
        assert segment.tokens(1000, 1600) == ids[1000:1600].tolist() and segment.token(2999) == ids[-1]
        with pytest.raises(IndexError):
            segment.token(3000)
    assert token_files.Segment(token_files.pack_levels(np.empty(0, np.uint32))).n_tokens == 0


# op7


def brute_repeats(rows, window=50):
    first = {}
    words = [(row[0], WORD.findall(row[1] or "")) for row in rows]
    for doc, w in words:
        for i in range(len(w) - window + 1) if doc is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, w in words:
        gone = set()
        for i in range(len(w) - window + 1) if doc is not None else ():
            if first[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


def test_substrings(docs, rows, empty):
    got = substrings.remove_repeats(docs).collect()
    want = brute_repeats(rows)
    assert sum(n for (_, _, removed, _), n in want.items() if removed) > 3
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_of_few_words(spark):
    r = random.Random(11)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.choice([0, 10, 49, 50, 51, 80, 300])))) for i in range(60)]
    rows += [(100 + i, "x " * r.randint(48, 140)) for i in range(6)]
    rows += [rows[7]] * 3
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), window=12, node=5).collect()
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got) == brute_repeats(rows, 12)


def test_words_that_weak_sums_confuse(spark):
    a, b = thue_morse()
    tail = " ".join(f"w{i}" for i in range(49))
    r = random.Random(1)
    long = ["".join(r.choice("ab") for _ in range(64)) for _ in range(2)]
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} {tail} more"), (4, f"{long[0]}{long[1]} {tail}"), (5, f"{long[1]}{long[0]} {tail}")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x.doc_id: x.n_removed for x in got} == {1: 0, 2: 0, 3: 50, 4: 0, 5: 0}


def test_paths_end_where_the_graph_branches(spark):
    """Edges a-b-c-d lie on one path; d forks into e and f, so these are paths of their own; g-h make a cycle."""
    links = {"a": (1, 2), "b": (2, 3), "c": (3, 4), "d": (4, 5), "e": (5, 6), "f": (5, 7), "g": (8, 9), "h": (9, 8)}
    rows = [(i, i, x << 32 | y, i << 16 | i) for i, (x, y) in enumerate(links.values())]
    rows.append((8, 8, 1 << 32 | 3, 0 << 16 | 1))  # a and b in one edge: the same words lead out of 1 and into 3
    got = substrings.goes_on(spark.createDataFrame(rows, "one bigint, two bigint, ends bigint, steps int")).collect()
    assert {"abcdefghi"[x.one] for x in got if x.on} == set("abcghi") and len(got) == 9


def test_spans_whose_words_differ_from_the_source_stay(spark, monkeypatch):
    """Where hashes are wrong the words decide: a span that isn't its source's stays."""
    df = spark.createDataFrame([(1, "a b r x y z"), (2, "p q r x y z")], "doc_id bigint, text string")
    tags = {x.doc_id: x.tag for x in df.select("doc_id", F.hash("text").alias("tag")).collect()}
    monkeypatch.setattr(substrings, "repeated_spans", lambda *a: spark.createDataFrame([(2, tags[2], 0, 2, (1, tags[1], 0)), (2, tags[2], 3, 1, (1, tags[1], 3))], "doc_id bigint, tag int, at int, n int, source struct<doc_id:bigint,tag:int,at:int>"))
    got = {x.doc_id: (x.n_removed, x.kept) for x in substrings.remove_repeats(df, window=3).collect()}
    assert got == {1: (0, "a b r x y z"), 2: (3, "p q r")}


# op8


def test_lines(docs, rows, empty, spark):
    got = lines.drop_fuzzy_lines(docs).collect()
    want = Counter(brute_lines(rows))
    assert Counter((x.doc_id, x.text, x.n_removed) for x in got) == want and sum(n * k for (*_, n), k in want.items()) > 10
    assert lines.drop_fuzzy_lines(empty).count() == 0


def test_common_shingles_counts_sets():
    r = random.Random(6)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 60))) for _ in range(40)] + ["é" * 9, "x"]
    sets = [lines.shingles(x) for x in texts]
    size, both = lines.common_shingles(texts)
    assert size.tolist() == [len(x) for x in sets]
    assert all(both[i, j] == len(a & b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    n, m, k = lines.pair_counts(texts[:-1], texts[1:])
    assert [*zip(n.tolist(), m.tolist(), k.tolist(), strict=True)] == [(len(a), len(b), len(a & b)) for a, b in zip(sets, sets[1:], strict=False)]


@pytest.mark.parametrize("held", [1, 7, 1 << 20])
def test_shared_buckets_over_any_batches(spark, monkeypatch, held):
    r = random.Random(4)
    rows = [(r.randrange(40), r.randrange(5)) for _ in range(120)]
    of = defaultdict(set)
    for bucket, line in rows:
        of[bucket].add(line)
    monkeypatch.setattr(lines, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = defaultdict(list)
    for x in lines._shared(spark.createDataFrame(rows, "bucket bigint, line bigint")).collect():
        got[x.bucket].append((x.line, x.first))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {b for b, xs in of.items() if len(xs) > 1}
    for bucket, found in got.items():
        assert len({f for _, f in found}) == 1 and sorted(x for x, _ in found) == sorted(of[bucket] - {found[0][1]})


@pytest.mark.parametrize("n", [9, 12, 18, 27, 45, 60])
def test_similar_lines_share_a_bucket_at_any_length(n):
    r = random.Random(n)
    lines_, pairs = [], 0
    while pairs < 300:  # lines of n shingles and an edit at either end or inside, 0.8 to 0.9 similar by brute force
        a = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n + 7))
        extra, at = "".join(r.choice("ABCDEF") for _ in range(r.randint(1, max(1, n // 4)))), r.randrange(n + 7)
        b = r.choice((a + extra, extra + a, a[:at] + extra[0] + a[at + 1 :]))
        if 0.8 <= lines.jaccard(lines.shingles(a), lines.shingles(b)) <= 0.9:
            lines_ += [a, b]
            pairs += 1
    bands = lines.band_hashes(lines_)
    assert (bands[0::2] == bands[1::2]).any(axis=1).mean() >= 0.99


def test_large_line_buckets_are_tiled(spark):
    r = random.Random(2)
    base = [r.choice("abcdefgh") for _ in range(200)]
    rows = []
    for i in range(120):
        x = list(base)
        x[r.randrange(200)] = "z"
        rows.append((i, "".join(x)))
    df = lines._documents(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    assert lines.line_components(df, tile=16).select("component").distinct().count() == 1


@pytest.mark.parametrize("tile", [4, 512])
def test_open_line_buckets_lose_no_link(spark, monkeypatch, tile):
    """All lines in one bucket, many components: cells of rare shingles and tiles find the same as all pairs."""
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared, texts = word(60), []
    for _ in range(25):
        own = shared + word(60)
        texts += [own, own + word(3), own[:70] + word(1) + own[71:]]
    rows = [(i, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = {lines._id(x): x for x in texts}
    monkeypatch.setattr(lines, "_buckets", lambda rows: spark.createDataFrame([(1, x) for x in ids], "bucket bigint, line bigint"))
    found = {x.line: x.component for x in lines.line_components(lines._documents(df, "doc_id", "text"), tile=tile).collect()}
    got = defaultdict(set)
    for x in ids:
        got[found.get(x, x)].add(ids[x])
    sets = {x: lines.shingles(x) for x in texts}
    parts = {x: {x} for x in texts}
    for a in texts:
        for b in texts:
            if parts[a] is not parts[b] and lines.jaccard(sets[a], sets[b]) >= 0.8:
                parts[a] |= parts[b]
                for x in parts[a]:
                    parts[x] = parts[a]
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in parts.values()} and len(got) > 10


# op9


def test_quality_counts(docs, rows, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(1, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.judge(docs, labels).collect()

    def counts(text):
        text = text or ""
        w = WORD.findall(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
        full = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered), failed

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[k] for k in names)) for r in got) == Counter((r[0], *counts(r[1])) for r in rows)
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels for any guarantee
    assert quality.judge(empty, labels).count() == 0 and quality.judge(docs, labels.where("false")).count() == len(rows)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_bound_is_exact(spark):
    strata = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 20)], "stratum string, n_good bigint")
    got = {r.stratum: r.most for r in quality.most_rejections(strata, 0.05, F.lit(0.01)).collect()}
    for name, n in (("a", 100), ("b", 1000), ("c", 20)):
        below, most = 0.0, None
        for k in range(n + 1):
            below += comb(n, k) * 0.05**k * 0.95 ** (n - k)
            if below > 0.01:
                break
            most = k
        assert got.get(name) == most


def test_quality_cutoffs_keep_the_good(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        text = " ".join(("w%d" % r.randrange(10**6)) + ("***" if bad else "") for _ in range(60))
        rows.append((i, text, "en"))
        labels.append((i, int(not bad)))
    judged = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    good, bad = [x for x in judged if x.doc_id % 5], [x for x in judged if x.doc_id % 5 == 0]
    assert not any(x.kept for x in bad) and sum(x.kept for x in good) >= 0.98 * len(good)


def test_quality_strata_without_a_bound_reject_by_the_base_rules_alone(spark):
    """Bad English documents have long words, as all documents of a rare language have: a cutoff over all would reject these."""
    r = random.Random(10)
    text = lambda n: " ".join("w" * (n - 6) + "%06d" % r.randrange(10**6) for _ in range(60))
    rows = [(i, text(20 if i % 5 == 0 else 8), "en") for i in range(3000)] + [(3000 + i, text(20), "de") for i in range(60)]
    labels = [(i, int(i % 5 > 0)) for i in range(3000)] + [(3000 + i, 1) for i in range(5)]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert all(x.kept for x in judged if x.doc_id >= 3000)
    assert not any(x.kept for x in judged if x.doc_id < 3000 and x.doc_id % 5 == 0)


def test_quality_sql_agrees_where_cutoffs_apply(spark, tmp_path):
    """Thousands of labels in two strata and few in a third: cutoffs are certified in two of them, in SQL as in Spark."""
    import duckdb

    from graphloom.llm import queries

    r = random.Random(12)
    rows, labels = [], []
    for i in range(4000):
        bad = r.random() < 0.25
        n = r.randint(60, 120)
        words = [("w%d" % r.randrange(10**6)) + ("#" * r.randint(0, 3) if bad or r.random() < 0.02 else "") for _ in range(n)]
        text = " ".join(words) + ("\nsame line\nsame line\nsame line" if bad and r.random() < 0.5 else "")
        rows.append((i, text, ("en", "de", "fr")[0 if i < 2200 else 1 if i < 3900 else 2], "s", len(text)))
        labels.append((i, int(not bad), 0))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = [tuple(x) for x in queries.op9_quality_rules(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(got) == sorted(con.execute(queries.ORACLE_SQL["op9_quality_rules"]).fetchall())
    rejected = Counter((rows[x[0]][2], labels[x[0]][1]) for x in got if not x[6] and not x[7])
    assert rejected[("en", 0)] > 50 and rejected[("de", 0)] > 50 and not rejected[("fr", 0)]


# op10


def test_simhash_large_buckets_are_blocked_again(spark):
    """Thousands of fingerprints that agree in 40 bits: every bucket over these is large, and rows grow by blocks, not by their square."""
    r = random.Random(8)
    base, ids = r.getrandbits(40) << 24, {}
    while len(ids) < 3000:
        ids[base | r.getrandbits(24)] = len(ids)
    by_id = {i: x for x, i in ids.items()}
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in by_id.items()], "id bigint, fp bigint")
    found = {r.id: r.component for r in components(simhash.links(df, tile=200)).collect()}
    assert {i: found.get(i, i) for i in by_id} == brute_components(by_id)
    assert all(sum(q) == (1 << 64) - 1 - m for m in simhash.block_masks() for q in [simhash.quarters(m)])


def test_simhash(unique, unique_docs, docs, rows, empty):
    fps = {r[0]: brute_fingerprint(r[1]) for r in unique}
    want = brute_components(fps)
    got = simhash.near_duplicates(unique_docs).collect()
    assert {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got} == {(k, v, want[k]) for k, v in fps.items()}
    assert len(set(want.values())) < len(want)
    assert simhash.near_duplicates(docs).count() == len(rows) and simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() < len(rows)
    assert {r.doc_id for r in simhash.keep_one(unique_docs).collect()} == set(want.values())


def test_simhash_links_lose_nothing(spark):
    r = random.Random(4)
    centres = [r.getrandbits(64) for _ in range(5)]
    fps = {}
    for i in range(700):
        x = r.choice(centres)
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randrange(64)
        fps[x] = i
    by_id = {i: x for x, i in fps.items()}
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in by_id.items()], "id bigint, fp bigint")
    want = brute_components(by_id)
    for tile in (8, 2048):
        found = {r.id: r.component for r in components(simhash.links(df, tile=tile)).collect()}
        assert {i: found.get(i, i) for i in by_id} == want


@pytest.mark.parametrize("together", [1 << 20, 20])
def test_components_of_long_chains(spark, monkeypatch, together):
    monkeypatch.setattr("graphloom.llm.components.TOGETHER", together)
    r = random.Random(6)
    order = list(range(300))
    r.shuffle(order)
    rows = [(order[i], order[i + 1]) for i in range(299) if i != 150] + [(5, 5), (None, 1)]
    got = {x.id: x.component for x in components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    one, two = order[:151], order[151:]
    assert got == {i: min(g) for g in (one, two) for i in g if i != min(g)}
