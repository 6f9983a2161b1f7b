"""Names that clash, null keys and empty tables, for every operator and pipeline stage."""

import corpus_pipeline
import pytest
from tessella.llm import crf, gru, mpeg, secrets, topk, toxicity
from tessella.llm.minhash import drop_near_duplicates, near_duplicates
from tessella.llm.packing import certified, pack, token_pieces
from tessella.llm.passages import repeats
from tessella.llm.pieces import segmentations

from .fixtures import frame
from .test_passages import numbered

#: Names that operators use, or once used, inside.
INSIDE = "_row _node _id _cut _digest _part _open _bins _bound _text row node body digest cut tag hub bucket bands k w held at id part open bins bound alone gone doc c0 c1 lettered key g i j chunk x y word n".split()
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in INSIDE)


def clashing(spark):
    p, q = numbered("p", 60), numbered("q", 80)
    texts = [(1, " ".join(q)), (2, " ".join(q[:79] + ["z"])), (3, " ".join(numbered("r", 30) + p)), (4, " ".join(numbered("s", 90) + p)), (5, None), (6, ""), (None, "one more text of words"), (None, "one more text of words"), (7, 'password = "abcdefghijklmnop1"'), (8, "  "), (8, "  ")]
    return spark.createDataFrame([(i, t, "en", "s", 1, *[f"{c}-{k}" for c in INSIDE]) for k, (i, t) in enumerate(texts)], SHAPE).repartition(2)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_keep_columns(spark, tmp_path):
    df = clashing(spark)
    before = {r[5]: r for r in told(df)}  # the first clashing column tells rows apart
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, str(tmp_path))
        assert got.columns == df.columns, name
        rows = told(got)
        assert rows and all(r[2:] == before[r[5]][2:] and r[0] == before[r[5]][0] for r in rows), name


def test_near_duplicates_keep_what_has_no_key(spark):
    got = [(r.doc_id, r.text) for r in drop_near_duplicates(clashing(spark)).collect()]
    assert got.count((None, "one more text of words")) == 2 and got.count((8, "  ")) == 2
    assert {i for i, _ in got} == {1, 3, 4, 5, 6, 7, 8, None}
    assert all(r.kept for r in near_duplicates(clashing(spark)).collect() if r.doc_id != 2)


def test_operators_ignore_other_columns(spark):
    df = clashing(spark)
    plain = df.select("doc_id", "text", "lang")
    for f in (repeats, near_duplicates, segmentations, secrets.find_secrets, crf.identify, gru.score, lambda d: mpeg.read_audio(mpeg.to_audio(d))):
        a, b = f(df), f(plain)
        assert a.columns == b.columns and a.count() == b.count()
    labels = spark.createDataFrame([(1, 1, "a"), (3, 0, "b")], "doc_id long, toxic int, text string")
    assert toxicity.score(df, labels).count() == df.count()
    v = spark.createDataFrame([(50, [1.0, 2.0], 1, 2), (51, [0.5, 0.5], 3, 4)], "vec_id long, embedding array<float>, v int, block int")
    assert [tuple(r)[:4] for r in topk.top_k(v).collect()] == [(50, 1, 51, 256 * 128 + 512 * 128)]


def test_packing_carries_columns(spark):
    pieces = token_pieces(clashing(spark)).selectExpr("*", "doc_id as _row", "piece as _part", "length as _open", "1 as _bins", "'x' as row", "2 as part")
    out, _ = pack(pieces, group=4)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"]
    assert told(out.drop("sequence_id", "offset")) == told(pieces)
    bins, bound = certified(out)
    assert bound <= bins <= bound + 1 and certified(out.limit(0)) == (0, 0)


@pytest.mark.parametrize("f", [lambda d: mpeg.read_audio(mpeg.to_audio(d)), secrets.find_secrets, secrets.redact, segmentations, repeats])
def test_empty_tables(spark, f):
    assert f(frame(spark).limit(0)).count() == 0
