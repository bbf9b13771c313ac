import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import mixing, queries
from tests_llm_brute import brute_components, brute_fingerprint, brute_lines, crc, ids_of  # noqa: I001

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tagged(docs):
    return mixing.with_domain(docs).withColumn("tokens", mixing.n_tokens())


@pytest.fixture(scope="module")
def folder(tmp_path_factory, unique_docs, spark):
    path = tmp_path_factory.mktemp("sf")
    unique_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name != "pack_sequences":
            assert docs.columns == columns and after
        if name == "quality_rules":  # too few labels for cutoffs: the base rules alone

            def failed(text):
                w = WORD.findall(text or "")
                n = Counter(zip(w, w[1:], w[2:], strict=False))
                covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[x] > 1 for k in range(3)}
                return len(w) < 50 or 100 * len(covered) > 50 * len(w)

            assert {r.doc_id for r in after} == {r.doc_id for r in before if not failed(r.text)}
        elif name == "line_dedup":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert all(r.n_chars == len(r.text) for r in after)
            assert Counter((r.doc_id, r.text) for r in after) == Counter((i, text) for i, text, _ in brute_lines([tuple(r) for r in before]))
        elif name == "near_dedup":
            groups = brute_components({r.doc_id: brute_fingerprint(r.text) for r in before})
            assert {r.doc_id for r in after} == set(groups.values()) and len(after) == len(set(groups.values()))
        elif name == "mix_sources":
            copies = Counter(r.doc_id for r in after)
            assert set(after) <= set(before) and max(copies.values()) <= 4
            plan = {(r.domain, r.lang, r.source): r for r in mixing.mix(tagged(spark.createDataFrame(before, out.schema)), weights=queries.MIX).collect()}
            taken, most = Counter(), {}
            for r in tagged(spark.createDataFrame(before, out.schema)).collect():
                leaf = (r.domain, r.lang, r.source)
                taken[leaf] += copies[r.doc_id] * r.tokens
                most[leaf] = max(most.get(leaf, 0), r.tokens)
            # a leaf takes its budget but for less than one document
            assert all(plan[k].budget - most[k] < n <= plan[k].budget for k, n in taken.items())
        else:
            places = defaultdict(list)
            for r in after:
                places[r.sequence_id].append((r.offset, r.length))
            for pieces in places.values():
                at = 0
                for offset, length in sorted(pieces):
                    assert offset == at
                    at += length
                assert at <= 1024
            want = Counter()
            for r in before:
                ids = ids_of(tokenizer, r.text)
                want.update((r.doc_id, i, len(ids[i : i + 1024]), crc(ids[i : i + 1024])) for i in range(0, len(ids), 1024))
            assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in after) == want
        before = after


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_nulls_repeats_and_clashing_columns(spark, docs, rows, folder):
    """Rows as the operators' tests have them: null ids and texts, repeated rows and ids, columns named as inner ones."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        found = out.collect()
        if name == "pack_sequences":
            assert Counter(r.doc_id for r in found if not r.start) == Counter(r[0] for r in rows)
        else:
            assert out.columns == docs.columns and found and {r.doc_id for r in found} <= {r[0] for r in rows}
        if name == "line_dedup":
            assert Counter((r.doc_id, r.text) for r in found) == Counter((i, text) for i, text, _ in brute_lines(rows))


def test_stages_on_an_empty_table(spark, empty, folder):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (name == "pack_sequences" or out.columns == empty.columns)
