"""The pipeline against the same steps done by hand."""

from tests.llm.test_dedup import brute_groups, brute_print, normal

import corpus_pipeline
from tessera.llm import packing, secrets
from tessera.llm.common import table


def test_stages_against_brute_force(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    now, wants = docs, []
    wants.append(set(kept))
    first = {}
    for i in sorted(kept):
        first.setdefault(normal(kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    wants.append(set(kept))
    groups = brute_groups({i: brute_print(t) for i, t in kept.items()})
    kept = {i: kept[i] for i in set(groups.values())}
    wants += [set(kept), set(kept)]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wants):
        now = table(stage(spark, now, str(tmp_path)))
        assert now.columns == corpus_pipeline.COLUMNS, name
        assert sorted(r["doc_id"] for r in now.collect()) == sorted(want), name
    assert {r["doc_id"]: r["text"] for r in now.collect()} == {i: secrets.redact(t) for i, t in kept.items()}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
    again = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    digest = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert digest(packed) == digest(again)


def test_empty_corpus(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_nulls_and_other_columns(spark, tmp_path):
    """Every stage on rows that repeat an id, null ids and texts, and a column that clashes with one used inside."""
    rows = [(1, "one text here", "en"), (1, "one text here", "en"), (1, "another text there", "en"), (None, "a third text token=abcdef1", "en"), (None, None, "en"), (7, "", None), (8, "one  text here", "en")]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _range int")
    now = docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = table(stage(spark, now, str(tmp_path)))
        assert now.columns == corpus_pipeline.COLUMNS
        kept.append(sorted((r["doc_id"] or 0, r["text"]) for r in now.collect()))
    whole = [(0, "a third text token=abcdef1"), (1, "another text there"), (1, "one text here"), (1, "one text here"), (8, "one  text here")]
    assert kept[0] == sorted(whole)
    assert kept[1] == sorted([whole[0], whole[1], whole[2]]) and kept[2] == kept[1]
    assert kept[3] == [(0, "a third text [secret]"), (1, "another text there"), (1, "one text here")]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or 0 for r in packed) == [0, 1, 1] and sum(r["length"] for r in packed) <= 2048 and len({r["sequence_id"] for r in packed}) == 1


def test_packing_beside_columns_of_any_name(spark):
    parts = spark.createDataFrame([(i, 0, 600 + i, "r", "b", "n", "t", "k", "p", -1, -1) for i in range(9)], "_id long, piece int, length long, _range string, _before string, _n string, _tie string, _rank string, _place string, sequence_id long, offset long")
    made = packing.pack(parts)
    assert sorted(made.columns) == sorted(parts.columns)
    got = made.collect()
    assert all(r["_range"] == "r" and r["_tie"] == "t" and r["sequence_id"] >= 0 for r in got) and len({(r["sequence_id"], r["offset"]) for r in got}) == 9
