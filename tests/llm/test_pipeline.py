import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from nocturne.llm import quality, simhash, substring, tokens

from .conftest import edited, prose
from .test_containment import shingles
from .test_quality import brute_rules
from .test_repeats import marks
from .test_simhash import jaccard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    clean = [(i, prose(1000 + i, 90 + 7 * i)) for i in range(40)]
    passage, item = prose(77, 70), prose(78, 40)
    planted = [
        (100, clean[3][1]), (101, clean[3][1]), (102, edited(clean[20][1], 5, 0.01)), (103, f"{prose(90, 80)} {passage} {prose(91, 70)}"),
        (104, f"{prose(92, 80)}\n{passage}\n{prose(93, 70)}"), (105, f"{prose(94, 100)} {item} {prose(95, 60)}"), (106, "### $$$ " * 80), (107, "too short"), (108, None), (109, ""),
        (110, f"{prose(96, 30)} {passage} {prose(97, 30)}"),
    ]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in clean + planted]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in [*range(40), 103, 104, 105, 110]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(79, 40))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The tables between the stages, as the pipeline makes them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(pipeline.table(stage(spark, out[-1], folder), name))
    return out


def held(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage_against_brute_force_on_its_own_input(stages):
    raw, good, single, cut, unleaked, coded = stages
    assert all(s.columns == COLUMNS for s in stages[:-1])
    texts = held(raw)
    assert held(good) == {i: t for i, t in texts.items() if not brute_rules(t)[-1]}
    before = held(good)
    gone = {i for i in before if any(j < i and jaccard(before[i], before[j]) >= 0.8 for j in before)}
    assert gone == {100, 101, 102} and held(single) == {i: t for i, t in before.items() if i not in gone}
    expected = marks(single.collect(), lambda t: (t or "").encode().split(), 20)
    kept = {k[0]: [w for w, g in zip(*v) if not g] for k, v in expected.items()}
    assert {i: t.encode().split() for i, t in held(cut).items()} == {i: w for i, w in kept.items() if w}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    items = [shingles(prose(78, 40)), shingles(prose(79, 40))]
    leaked = {i for i, t in held(cut).items() if any(len(q & shingles(t)) >= 0.8 * len(q) for q in items)}
    assert leaked == {105} and held(unleaked) == {i: t for i, t in held(cut).items() if i not in leaked}
    coder = tokens.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded.collect()}
    want = {}
    for i, t in held(unleaked).items():
        ids = coder.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want and set(range(40)) <= set(got)


def test_run_applies_the_stages(spark, folder, stages):
    assert sorted(map(str, entry.queries()["pipeline"](spark, folder).collect())) == sorted(map(str, stages[-1].collect()))


def test_names_and_oracles():
    names = entry.queries()
    assert [re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)] == [str(i) for i in range(1, 14)]
    assert len(pipeline.STAGES) == 5 and set(entry.oracle_sql()) <= set(names)
